import corpus_pipeline
import public_tokenizers
from tessel.llm import byte_bpe, decontaminate, jaccard_join, language, quality
from tessel.llm.queries import QUERIES

from .test_dedup import brute_lines
from .test_join import brute
from .test_models import brute_contamination

SMALL = "/root/testdata/sf0.001"


def test_every_stage_against_brute_force(spark):
    """Each stage's rows follow from the rows of the one before, and its decisions take effect."""
    table = spark.read.parquet(f"{SMALL}/documents.parquet")
    docs, before = table, {r.doc_id: r.text for r in table.collect()}
    rows = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = jaccard_join.keep(stage(spark, docs, SMALL))
        rows[name] = {r.doc_id: r.text for r in docs.collect()}
        if name != "byte_bpe":
            assert docs.columns == table.columns
    network = quality.fit(table, spark.read.parquet(f"{SMALL}/labels.parquet").where(~language.held_out(language.F.col("doc_id"))))
    good = {r.row.doc_id for r in quality.predict(table, network).where("score >= 0.7").collect()}
    assert rows["quality_classifier"] == {i: t for i, t in before.items() if i in good} and 0 < len(good) < len(before)
    assert rows["line_dedup"] == brute_lines(list(rows["quality_classifier"].items()))
    groups = brute(list(rows["line_dedup"].items()), 5, 80, 100)
    assert rows["ngram_jaccard_join"] == {i: t for i, t in rows["line_dedup"].items() if groups[i][1] == i}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    facts = {i: brute_contamination(t, items) for i, t in rows["ngram_jaccard_join"].items()}
    clean = {i for i, (n, hit, _) in facts.items() if not (hit and 20 * hit >= n)}
    assert rows["benchmark_decontamination"] == {i: t for i, t in rows["ngram_jaccard_join"].items() if i in clean}
    assert rows["byte_bpe"] == rows["benchmark_decontamination"]
    vocabulary = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    encoder = byte_bpe.Encoder(byte_bpe.model_bytes(vocabulary), vocabulary, public_tokenizers.PATTERN)
    assert all(bytes(r.token_ids) == encoder(r.text) for r in docs.collect())
    assert {r.doc_id: r.text for r in corpus_pipeline.run(spark, SMALL).collect()} == rows["byte_bpe"]


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == [*range(1, 14)]
    assert decontaminate.BLOCK_BYTES and corpus_pipeline.ORACLE_SQL is None


def test_run_on_an_awkward_table(spark, tmp_path):
    """Nulls, empty texts, ties and repeated rows end to end: every stage's rule for them, from the first table to the last."""
    good = [r for r in spark.read.parquet(f"{SMALL}/documents.parquet").where("length(text) > 400").orderBy("doc_id").limit(40).collect()]
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in good]
    rows += [rows[0], (None, rows[1][1], "en", None, 5), (9001, None, None, "s", None), (9002, "", "en", "s", 0), (9003, rows[2][1], "en", "s", 1), (9004, "x" * 200_000, "en", "s", 200_000)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    folder = tmp_path / "odd"
    table.write.parquet(str(folder / "documents.parquet"))
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SMALL}/{name}.parquet").write.parquet(str(folder / f"{name}.parquet"))
    docs, before = spark.read.parquet(str(folder / "documents.parquet")), len(rows)
    for name, stage in corpus_pipeline.STAGES:
        docs = jaccard_join.keep(stage(spark, docs, str(folder)))
        n = docs.count()
        assert n == before if name in ("line_dedup", "byte_bpe") else n <= before
        before = n
    facts = lambda df: sorted((-1 if r.doc_id is None else r.doc_id, r.text) for r in df.collect())
    final = facts(docs)
    assert final == facts(corpus_pipeline.run(spark, str(folder)))
    texts = dict(final)
    assert len(texts) == len(final) and all(t is not None for t in texts.values())
    assert all(not texts.get(i) for i in (-1, 9001, 9002, 9003))  # copies lose all their lines to the smaller id
