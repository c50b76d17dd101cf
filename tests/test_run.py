"""Sources, sinks, index and whole runs on the small synthetic fixtures."""

import csv
import gzip
import io
import json
import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from seqloom import cli
from seqloom.common import table
from seqloom.operators import sampling
from seqloom.plans import queries, run
from seqloom.sources import fasta, fastq, index, report
from seqloom.streaming import sample as streaming
from tests.test_operators import xorshift

HOST, TARGET, OTHER = xorshift(17, 600), xorshift(91, 600), xorshift(321, 600)


def put(path, text):
    with (gzip.open if path.endswith(".gz") else open)(path, "wb") as f:
        f.write(text.encode("latin-1"))
    return path


def fq(reads, end=""):
    return "".join(f"@read{i}{end}\n{r}\n+\n{'I' * len(r)}\n" for i, r in enumerate(reads))


@pytest.fixture(scope="module")
def home():
    return tempfile.mkdtemp(prefix="seqloom-test-")


@pytest.fixture(scope="module")
def panel(spark, home):
    host = put(f"{home}/host.fa", f">h1 host\n{HOST[:300]}\n{HOST[300:]}\n")
    target = put(f"{home}/target.fa", f">alpha-copy\n{TARGET.lower()}\n>alpha | first\n{TARGET}\n\n>zeta <&\"\n{OTHER}\n")
    cli.build(spark, host, target, f"{home}/index")
    return f"{home}/index"


def test_fasta_reading(spark, home):
    path = put(f"{home}/a.fa", "\n>one  | about it \r\nAC GT\r\nmr\n>two\nNNN\n\n")
    rows = [(r.rec_ordinal, r.id, r.description, r.sequence) for r in fasta.read_fasta(spark, path).orderBy("rec_ordinal").collect()]
    assert rows == [(0, "one", "about it", "ACGTMR"), (1, "two", "", "NNN")]
    for text, word in ((">x\nACGE\n", "IUPAC"), (">\nACGT\n", "without an id"), (">x\n\n>y\nA\n", "empty sequence"), ("ACGT\n>x\nA\n", "before the first header")):
        with pytest.raises(Exception, match=word):
            fasta.read_fasta(spark, put(f"{home}/bad.fa", text)).collect()
    folder = tempfile.mkdtemp(dir=home)  # many small files in one task: each is looked at from its start
    for i in range(13):
        put(f"{folder}/{i:02d}.fa", f">x{i}\nACGT\n>y{i}\nGG\n")
    assert fasta.read_fasta(spark, folder).count() == 26
    put(f"{folder}/07.fa", "ACGT\n>x7\nACGT\n")
    with pytest.raises(Exception, match="before the first header"):
        fasta.read_fasta(spark, folder).collect()
    with pytest.raises(ValueError, match="repeats"):
        fasta.check_fasta(fasta.read_fasta(spark, put(f"{home}/twice.fa", ">x\nA\n>x\nC\n")))
    with pytest.raises(ValueError, match="no FASTA"):
        fasta.check_fasta(fasta.read_fasta(spark, put(f"{home}/none.fa", "\n")))


def test_fastq_reading(spark, home):
    good = put(f"{home}/s_R1.fastq.gz", fq(["ACGT", "", "acN-"], "/1"))
    with gzip.open(good, "ab") as more:  # a second gzip member
        more.write(b"@x y\r\nAA\r\n+\r\nII\r\n")
    rows = [(r.ordinal, r.id, r.r1, r.r2) for r in fastq.read_fragments(spark, good).orderBy("ordinal").collect()]
    assert rows == [(0, "read0", "ACGT", None), (1, "read1", "", None), (2, "read2", "acN-", None), (3, "x", "AA", None)]
    for text, word in (("@a\nAC\n+\n", "quality"), ("@a\nAC\n", "plus"), ("@a\n", "sequence"), ("a\nAC\n+\nII\n", "start with @"), ("@ \nAC\n+\nII\n", "no id"), ("@a\nAC\n+\nI\n", "qualities"), ("@a\nAC\nI\nII\n", "no \\+"), ("@a\nAC\n+\nII\n\n", "start with @")):
        with pytest.raises(Exception, match=word):
            fastq.read_fastq(spark, put(f"{home}/bad.fq", text)).collect()
    with open(good, "rb") as f:
        half = f.read()[:40]
    with open(f"{home}/half.fq.gz", "wb") as f:
        f.write(half)
    with pytest.raises(Exception):  # noqa: B017
        fastq.read_fastq(spark, f"{home}/half.fq.gz").collect()


def test_pairs(spark, home):
    a, b = put(f"{home}/p1.fq", fq(["AC", "GT"], "/1")), put(f"{home}/p2.fq", fq(["TT", "CC"], "/2 x"))
    assert sorted((r.id, r.r1, r.r2) for r in fastq.read_fragments(spark, a, b).collect()) == [("read0", "AC", "TT"), ("read1", "GT", "CC")]
    with pytest.raises(Exception, match="different record counts"):
        fastq.read_fragments(spark, a, put(f"{home}/p3.fq", fq(["TT"]))).collect()
    with pytest.raises(Exception, match="do not match"):
        fastq.read_fragments(spark, a, put(f"{home}/p4.fq", fq(["TT", "CC"]).replace("read1", "other"))).collect()
    plain, packed = put(f"{home}/d.fq", fq(["AC"])), put(f"{home}/d.fq.gz", fq(["AC"]))
    assert fastq.input_digest(spark, plain) == fastq.input_digest(spark, packed) != fastq.input_digest(spark, plain, packed)
    # several files an end follow each other, and each file goes with its own mate's
    c, e = put(f"{home}/p5.fq", fq(["AA", "CC", "GG"], "/1")), put(f"{home}/p6.fq", fq(["TA", "TC", "TG"], "/2"))
    rows = [(r.ordinal, r.r1, r.r2) for r in fastq.read_fragments(spark, f"{a},{c}", f"{b},{e}").orderBy("ordinal").collect()]
    assert rows == [(0, "AC", "TT"), (1, "GT", "CC"), (2, "AA", "TA"), (3, "CC", "TC"), (4, "GG", "TG")]
    assert fastq.read_fragments(spark, f"{a},{c}").count() == 5
    with pytest.raises(ValueError, match="numbers of files"):
        fastq.read_fragments(spark, f"{a},{c}", b)


def test_split_fastq(spark, home, monkeypatch):
    """Parts of any size give the records of the whole file, in order, with qualities that look like headers."""
    rng = random.Random(5)
    reads = ["".join(rng.choice("ACGTN") for _ in range(rng.choice([0, 1, 7, 60, 150]))) for _ in range(700)]
    text = "".join(f"@r{i} x\r\n{r}\r\n+{rng.choice(['', '@'])}\r\n{''.join(rng.choice('@+I#') for _ in r)}\r\n" for i, r in enumerate(reads))
    path = put(f"{home}/long.fq", text)
    for size in (997, 4096, 1 << 20):
        rows = fastq.read_fastq(spark, path, part_bytes=size).orderBy("ordinal").collect()
        assert [(r.ordinal, r.id, r.sequence) for r in rows] == [(i, f"r{i} x", r) for i, r in enumerate(reads)]
    monkeypatch.setattr(fastq, "LINK_BYTES", 1000)
    packed = put(f"{home}/long.fq.gz", text)
    digests = fastq.content_digests(spark, [path, packed])
    assert digests[path] == digests[packed]
    folder = tempfile.mkdtemp(dir=home)
    for i in range(2):
        put(f"{folder}/part{i}.fq", fq(reads[i * 100 : i * 100 + 100]))
    put(f"{folder}/_SUCCESS", "")
    assert fastq.read_fastq(spark, folder).count() == 200
    with pytest.raises(Exception, match="truncated"):
        fastq.read_fastq(spark, put(f"{home}/long2.fq", text[:-200]), part_bytes=4096).collect()


def test_index_round_trip_and_damage(spark, panel, home):
    manifest, tables = index.load_index(spark, panel)
    groups = tables["groups"].orderBy("group_ordinal").collect()
    assert sorted(tuple(g.member_ids) for g in groups) == [("alpha", "alpha-copy"), ("zeta",)]
    assert tables["contigs"].count() == 3 and len(index.index_digest(manifest)) == 64
    index.write_ledger(tables["groups"], f"{home}/ledger")
    assert index.read_ledger(spark, f"{home}/ledger").count() == 3
    for damage in ({"unknown": 1}, {"groups": "0" * 64}, {"contract": "x"}):
        path = tempfile.mkdtemp(dir=home)
        for t in index._TABLES:
            spark.read.parquet(f"{panel}/{t}").write.parquet(f"{path}/{t}")
        spark.createDataFrame([(json.dumps(manifest | damage),)], "v string").coalesce(1).write.text(f"{path}/manifest")
        with pytest.raises(ValueError, match="rebuild"):
            index.load_index(spark, path)
    assert manifest["bloom"]["inserted"] == tables["kmers"].count() and len(manifest["host_fasta_sha256"]) == 64
    with pytest.raises(FileExistsError):
        cli.build(spark, f"{home}/host.fa", f"{home}/target.fa", panel)
    with pytest.raises(Exception):  # noqa: B017
        cli.build(spark, f"{home}/host.fa", put(f"{home}/worse.fa", ">x\nACGE\n"), f"{home}/never")
    assert not [f for f in os.listdir(home) if f.startswith("never")]
    with pytest.raises(ValueError, match="rebuild"):
        index.load_index(spark, f"{home}/nothing")
    with pytest.raises(ValueError, match="dense"):
        index.validate_groups(tables["groups"].withColumn("group_ordinal", F.col("group_ordinal") + 1))


def rows_of(path):
    with open(f"{path}/report.csv", "rb") as f:
        raw = f.read()
    assert raw.startswith(b"\xef\xbb\xbf") and raw.endswith(b"\r\n")
    rows = list(csv.DictReader(io.StringIO(raw[3:].decode())))
    assert list(rows[0]) == report.COLUMNS
    return rows


@pytest.mark.parametrize("mode", ["screen", "full"])
def test_single_ends(spark, panel, home, mode):
    r1 = put(f"{home}/se_{mode}.fastq.gz", fq([TARGET[i % 30 : i % 30 + 120] for i in range(20)]))
    out = f"{home}/out_se_{mode}"
    cli.run(spark, r1, None, panel, out, mode)
    (row,) = rows_of(out)
    assert row["support_fragments"] == row["selected_fragments"] == row["input_fragments"] == "20" and row["support_pct"] == "100"
    assert row["sample_id"] == f"se_{mode}" and row["input_mode"] == "SE" and float(row["sampling_target_score"]) > 0.99
    assert row["reference_id"] == "alpha" and row["reference_member_ids"] == "alpha;alpha-copy" and row["covered_bp"] == "139"
    with open(f"{out}/report.html") as f:
        page = f.read()
    assert "data:text/csv" in page and all(f'data-field="{n}"' in page for n in [*report.COLUMNS, *report.RUN_FIELDS, *report.TARGET_FIELDS])
    assert len(report.RUN_FIELDS) == len(report.TARGET_FIELDS) == 26 and "CONFORMANT_COMPLETE" in page and "RESOLVED" not in page and "AMBIGUOUS_WITHIN_GROUP" in page
    with open(f"{out}/perf.json") as f:
        perf = json.load(f)
    assert list(perf) == report.PERF_FIELDS and len(perf) == 20 and perf["status"] == "SUCCESS" and perf["selected_fragments"] == 20 and perf["wall_time_ms"] > 0
    with pytest.raises(FileExistsError):
        cli.run(spark, r1, None, panel, out, mode)


def test_ranking_pairs_and_denominator(spark, panel, home):
    reads = [TARGET[i : i + 120] for i in range(6)] + [OTHER[i : i + 120] for i in range(3)] + [HOST[i : i + 120] for i in range(2)]
    mates = [s[::-1].translate(str.maketrans("ACGT", "TGCA")) for s in reads]
    a, b = put(f"{home}/m_R1.fastq", fq(reads, "/1")), put(f"{home}/m_R2.fastq", fq(mates, "/2"))
    cli.run(spark, a, b, panel, f"{home}/out_pe", "screen")
    rows = rows_of(f"{home}/out_pe")
    assert [(r["reference_id"], r["support_rank"], r["support_fragments"], r["input_mode"]) for r in rows] == [("alpha", "1", "6", "PE"), ("zeta", "2", "3", "PE")]
    assert [r["target_support_share_pct"] for r in rows] == ["66.666667", "33.333333"] and rows[0]["support_pct"] == "54.5454545455"
    with open(f"{home}/out_pe/report.html") as f:
        assert "&lt;&amp;&quot;" in f.read()


def test_nothing_found_and_failure(spark, panel, home):
    short = put(f"{home}/short.fq", fq([TARGET[:20]] * 100))
    cli.run(spark, short, None, panel, f"{home}/out_none")
    (row,) = rows_of(f"{home}/out_none")
    assert row["sample_id"] == "short" and row["input_fragments"] == "100" and row["reference_id"] == ""
    with open(f"{home}/out_none/report.html") as f:
        page = f.read()
    assert "TARGET_KMER_NOT_EVALUABLE_INPUT_FRAGMENTS=100" in page and "CONFORMANT_WITH_LIMITATIONS" in page and "No selected fragment passed the gate." in page
    # full mode gates all fragments: it counts those it can't evaluate although none is sampled
    cli.run(spark, put(f"{home}/some.fq", fq([TARGET[:20]] * 5 + [TARGET[:120]] * 3)), None, panel, f"{home}/out_some", "full")
    with open(f"{home}/out_some/perf.json") as f:
        figures = json.load(f)
    with open(f"{home}/out_some/report.html") as f:
        assert "TARGET_KMER_NOT_EVALUABLE_INPUT_FRAGMENTS=5" in f.read()
    assert figures["prescreen_passed_fragments"] == figures["selected_fragments"] == 3
    with pytest.raises(Exception):  # noqa: B017
        cli.run(spark, put(f"{home}/cut.fq", "@a\nAC\n"), None, panel, f"{home}/out_bad")
    assert os.listdir(f"{home}/out_bad") == ["perf.json"]
    assert cli.main(["run", "--r1", f"{home}/cut.fq", "--index", panel, "--out", f"{home}/out_bad2"]) == 1
    with open(f"{home}/out_bad/perf.json") as f:
        perf = json.load(f)
    assert perf["status"] == "ERROR" and "truncated" in perf["sample_errors"][0] and list(perf) == report.PERF_FIELDS
    for more in (["--precision", "0.1"], ["--r1", "again"], ["--mode", "full", "--mode", "full"]):
        with pytest.raises(SystemExit):
            cli.main(["run", "--r1", "x", "--index", "y", "--out", "z", *more])


def test_stream_equals_batch(spark, data):
    design = table(spark, data, "sampling_design")
    batch = {(r.ordinal, r.key) for r in sampling.bottom_k_by_run(sampling.keyed(table(spark, data, "fragments")), design).collect()}
    folder = tempfile.mkdtemp() + "/fragments.parquet"
    table(spark, data, "fragments").repartition(7).write.parquet(folder)
    for d in (data, os.path.dirname(folder)):
        stream = streaming.stream_table(spark, d, "fragments", files_per_batch=2)
        assert {(r.ordinal, r.key) for r in streaming.stream_bottom_k(stream, design).collect()} == batch


def test_streams_resume(spark, data):
    """Started again with its folder, a stream goes on behind the batches that are done."""
    design, rows = table(spark, data, "sampling_design"), table(spark, data, "fragments")
    home = tempfile.mkdtemp()
    rows.filter("ordinal % 2 = 0").repartition(3).write.parquet(f"{home}/fragments.parquet")
    stream = lambda: streaming.stream_table(spark, home, "fragments", files_per_batch=1)
    streaming.stream_bottom_k(stream(), design, folder=f"{home}/state")
    streaming.stream_window_counts(stream(), folder=f"{home}/counts")
    rows.filter("ordinal % 2 = 1").repartition(2).write.mode("append").parquet(f"{home}/fragments.parquet")
    want = {(r.ordinal, r.key) for r in sampling.bottom_k_by_run(sampling.keyed(rows), design).collect()}
    assert {(r.ordinal, r.key) for r in streaming.stream_bottom_k(stream(), design, folder=f"{home}/state").collect()} == want
    assert len(streaming._written(spark, f"{home}/state/state")) == 5
    whole = {tuple(r) for r in streaming.stream_window_counts(streaming.stream_table(spark, data, "fragments")).collect()}
    assert {tuple(r) for r in streaming.stream_window_counts(stream(), folder=f"{home}/counts").collect()} == whole


def test_window_counts_are_whole(spark, data):
    """Seven unordered files in batches of two, and one file: the same as a plain group-by over all rows."""
    folder = tempfile.mkdtemp() + "/fragments.parquet"
    table(spark, data, "fragments").orderBy(F.desc("arrived_at")).coalesce(1).write.option("maxRecordsPerFile", 160).parquet(folder)
    assert len([f for f in os.listdir(folder) if f.endswith(".parquet")]) > 4
    table(spark, data, "fragments").createOrReplaceTempView("all_fragments")
    plain = """select run_id, floor(unix_seconds(at) / 21600) as w, count(*) as fragments, sum(ends) as reads from
      (select ordinal, cast(arrived_at as timestamp) as at, min(run_id) as run_id, max(if(r2 is null, 1, 2)) as ends from all_fragments where arrived_at is not null group by 1, 2) group by 1, 2"""
    want = {tuple(r) for r in spark.sql(plain).collect()}
    for d in (data, os.path.dirname(folder)):
        got = streaming.stream_window_counts(streaming.stream_table(spark, d, "fragments", files_per_batch=2))
        assert {tuple(r) for r in got.select("run_id", F.floor(F.unix_seconds("window_start") / 21600), "fragments", "reads").collect()} == want
    empty = streaming.stream_table(spark, data, "fragments").filter("false")
    assert streaming.stream_window_counts(empty).count() == 0


def test_estimates_are_of_the_sample(spark, data):
    """Support is counted within the drawn sample, so it never exceeds it and every group has an interval."""
    keyed = sampling.keyed(table(spark, data, "fragments")).collect()
    passed = {r.ordinal for r in queries.gate_verdict(spark, data).collect() if r.verdict == "Pass"}
    sample = set()
    for r in table(spark, data, "sampling_design").collect():
        mode = r.mode.lower()
        rows = sorted((x.key, x.ordinal) for x in keyed if x.run_id == r.run_id and (mode == "screen" or x.ordinal in passed))
        sample |= {o for _, o in rows[: r.capacity]} & passed
    hits = table(spark, data, "hits").filter(F.col("ordinal").isin(sorted(sample)))
    counted = run.evidence_by_run(hits, table(spark, data, "fragments"), table(spark, data, "reference_groups"))
    want = {(r.run_id, r.group_ordinal): r.supporting_selected_fragments for r in counted.collect() if r.supporting_selected_fragments}
    rows = queries.interval_report(spark, data).collect()
    assert want and {(r.run_id, r.group_ordinal): r.supporting_selected_fragments for r in rows} == want
    for r in rows:
        assert r.supporting_selected_fragments <= r.selected and r.supporting_selected_fragments <= r.lower_count <= r.upper_count <= r.population
    modes = {r.run_id: r.input_mode for r in queries.input_census(spark, data).collect()}
    assert {(r.sample_id, r.input_mode) for r in queries.report_text(spark, data).collect()} == {(r.run_id, modes[r.run_id]) for r in rows}


def test_estimates_are_stored_step_by_step(spark, data):
    """Reports start from stored estimates: the driver never plans the gate, the sample, the evidence and the report as one."""
    plan = queries.QUERIES["report_counts"](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan and "Relation" not in plan
