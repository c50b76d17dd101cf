"""Fixed values of the analysis: they must be these for results to agree."""

import hashlib
import json
from enum import StrEnum

# The IUPAC letters in code order, their complements, and the codes as hex digits.
ALPHABET = "ACGTMRWSYKVHDBN"
COMPLEMENT = "TGCAKYWSRMBDHVN"
FORWARD_CODE = "0123456789abcde"
REVERSE_CODE = "3210986754dcbae"

# K-mer length, and what the seeds of an end must reach to pass.
KMER = 21
MIN_HITS = 2
MIN_COVERED = 25

# The low-complexity mask.
DUST_WINDOW = 64
DUST_THRESHOLD = 20

# Error budgets, and the least relative abundance of each precision, as one part in so many.
FAMILY_MISS = 0.05
FAMILY_INTERVAL = 0.05
PRECISIONS = {"fast": 10_000, "standard": 100_000, "sensitive": 1_000_000}

# Windows of a reference for the spread of support, and rows of the short list.
OCCUPANCY_WINDOWS = 10
TOP_ROWS = 20

# Alignment scores (match, mismatch, gap opening, gap extension) and the least score of a hit.
MATCH, MISMATCH, GAP_OPEN, GAP_EXTEND, MIN_SCORE = 2, -8, 12, 2, 40


class RunMode(StrEnum):
    """screen samples and then gates, full gates and then samples."""

    SCREEN = "screen"
    FULL = "full"


class Precision(StrEnum):
    """What a sample's size is made for: the least relative abundance that should be seen."""

    FAST = "fast"
    STANDARD = "standard"
    SENSITIVE = "sensitive"


def profile_digest() -> str:
    """SHA-256 of all values above: what an index and a sampling key depend on besides the data."""
    values = {k: v for k, v in globals().items() if k.isupper()}
    return hashlib.sha256(json.dumps(values, sort_keys=True).encode()).hexdigest()
