from collections import Counter

import corpus_pipeline
from test_bitplanes import brute as brute_tokens
from test_decontam import brute as brute_hits
from test_jaccard import brute as brute_classes
from test_mixing import brute as brute_mix

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "decontamination", "mixture", "token_files"]
    odd = spark.createDataFrame([(9001, "123 !", "en", "src0", 5), (9002, None, None, None, 0), (9003, "", "fr", "src1", 0)], docs.schema)
    now = docs.unionByName(odd)

    out = corpus_pipeline.language_id(spark, now, SF)
    want = {r.doc_id for r in docs.collect() if any(c.isalpha() for c in r.text or "")}
    assert out.columns == columns and {r.doc_id for r in out.collect()} == want

    now = out.checkpoint()
    out = corpus_pipeline.near_duplicates(spark, now, SF)
    want = {c for _, c, _, _ in brute_classes([(r.doc_id, r.text) for r in now.collect()])}
    assert out.columns == columns and sorted(r.doc_id for r in out.collect()) == sorted(want)

    now = out.checkpoint()
    out = corpus_pipeline.decontamination(spark, now, SF)
    want = {r[0] for r in brute_hits([(r.doc_id, r.text) for r in now.collect()], items) if not r[5]}
    assert out.columns == columns and sorted(r.doc_id for r in out.collect()) == sorted(want)

    now = out.checkpoint()
    out = corpus_pipeline.mixture(spark, now, SF)
    got = Counter((r.doc_id, r.text, r.source) for r in out.collect())
    assert out.columns == columns and got == brute_mix([(r.doc_id, r.text, r.source) for r in now.collect()])

    now = out.checkpoint()
    out = corpus_pipeline.token_files(spark, now, SF).collect()
    assert sorted(r.doc_id for r in out) == sorted(r.doc_id for r in now.collect())
    ordered = sorted(out, key=lambda r: r.start)
    assert all(a.start + a.n_tokens == b.start for a, b in zip(ordered, ordered[1:], strict=False))
    want = brute_tokens(sorted((r.doc_id, r.text) for r in now.collect()))
    assert sorted(map(tuple, out)) == sorted(want)
    assert [r.doc_id for r in ordered] == sorted(r.doc_id for r in ordered)


def test_run_is_the_stages(spark):
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_odd_rows_pass_every_stage(spark, tmp_path):
    """Nulls in any column, empty and very long texts, repeated rows and an empty table."""
    text = "A sentence of plain words that says something about the weather today"
    rows = [
        (1, None, None, None, None), (2, "", "en", "s", 0), (None, text, "en", "s", 5), (None, text, "en", "s", 5), (3, text + " and tomorrow", None, None, None),
        (4, " ".join(f"word{i}" for i in range(60_000)), "en", "s", 1), (5, "0123 !!", "fr", "t", 2), (6, "Ein Satz", "de", "t", 8), (6, "Ein anderer Text", "de", None, 8),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for i, part in enumerate((rows, [])):
        sf = str(tmp_path / str(i))
        spark.createDataFrame(part, schema).write.parquet(f"{sf}/documents.parquet")
        spark.createDataFrame([(1, "nothing of this occurs in any of the rows above at all"), (2, None)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
        got = corpus_pipeline.run(spark, sf).collect()
        assert {r.doc_id for r in got} <= {None, 3, 4, 6} and bool(got) == bool(part)
        assert sum(r.n_tokens for r in got) == max((r.start + r.n_tokens for r in got), default=0)
