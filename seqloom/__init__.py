"""seqloom: read-panel analytics and corpus data processing as plain PySpark DataFrame jobs.

build_index(spark, host, target, out) and run_pipeline(spark, r1, r2, index_path, out, mode, precision) are the two whole
jobs; RunMode, Precision and RunSummary go with them. All else is imported from its module.
"""

_API = {"build_index": ("seqloom.cli", "build"), "run_pipeline": ("seqloom.cli", "run"), "RunMode": ("seqloom.constants", "RunMode"), "Precision": ("seqloom.constants", "Precision"), "RunSummary": ("seqloom.sources.report", "RunSummary")}
__all__ = list(_API)


def __getattr__(name: str):
    """Imported when first asked for, so that tasks which need one small module load no more."""
    if name in _API:
        import importlib

        module, attribute = _API[name]
        return getattr(importlib.import_module(module), attribute)
    raise AttributeError(name)
