"""Search over the index on disk against the scan."""

import pytest
from pyspark.sql import functions as F

from factloom.operators import search, text_index
from factloom.plans import views

QUERIES = (
    "The and GET /api/v1/d3/items Type7", "type29", "para como sobre", "zzzqqq", "ty", "", "permisos administrativos", "GET /api/v1/d5/items", "ação", "items", "x/d7", "señal de prueba", "😀 emoji text", "/api/v1/d1",
)


@pytest.fixture(scope="module")
def chunks(spark, sf):
    own = views.chunks(spark, sf)
    odd = own.limit(1)
    none = lambda c: F.lit(None).cast(odd.schema[c].dataType).alias(c)
    empty = odd.select(*(none(c) if c not in ("symbols", "source_paths", "confidence_states") else c for c in odd.columns))
    special = odd.withColumns({"id": F.lit("special"), "content": F.lit("Señal DE Prueba 😀 emoji text ação"), "endpoint": F.struct(F.lit(None).cast("string").alias("method"), F.lit("").alias("path"))})
    return own.unionByName(empty).unionByName(special).unionByName(special)


@pytest.fixture(scope="module")
def index(spark, chunks, tmp_path_factory):
    return text_index.build(chunks, f"file://{tmp_path_factory.mktemp('search')}", 8)


def told(df):
    return [(r["score"], r["document_path"], r["id"]) for r in df.collect()]


@pytest.mark.parametrize("query", QUERIES)
def test_equals_the_scan(query, chunks, index):
    got, read = text_index.search(index, query, limit=30)
    assert told(got) == told(search.search_documents(chunks, query, limit=30))
    n = {r["what"]: r["n"] for r in read.collect()}
    assert n["candidates"] <= n["chunks"] == chunks.count()
    if query == "type29":
        assert n["candidates"] < n["chunks"] / 5


def test_repository_and_many_candidates(chunks, index, monkeypatch):
    monkeypatch.setattr(text_index, "FEW", 3)
    for query in QUERIES[:2]:
        repository = chunks.filter("repository_id is not null").first()["repository_id"]
        assert told(text_index.search(index, query, repository)[0]) == told(search.search_documents(chunks, query, repository))


def test_torn_and_foreign_indexes_are_refused(spark, chunks, tmp_path):
    root = f"file://{tmp_path}/search"
    built = text_index.build(chunks.limit(5), root, 2)
    empty = text_index.build(chunks.limit(0), f"{root}-empty", 2)
    assert text_index.search(empty, "type29")[0].count() == 0
    built.postings.limit(1).write.mode("append").partitionBy("part").parquet(f"{built.folder}/postings")
    with pytest.raises(ValueError, match="isn't what was built"):
        text_index.load(spark, root)
    newest = spark.read.parquet(f"{root}/manifest").withColumns({"version": F.lit(9), "built_at": F.current_timestamp()})
    newest.write.mode("append").parquet(f"{root}/manifest")
    with pytest.raises(ValueError, match="layout 9"):
        text_index.load(spark, root)


def test_postings_grow_by_block_and_not_by_chunk(index, chunks):
    """A gram has one row for each block of texts that holds it; what it counts are chunks."""
    n = {r["gram"]: r["n"] for r in index.grams.collect()}
    assert index.postings.count() < sum(n.values()) / 5
    texts = [f"{r['meta']}\n{r['body']}" for r in chunks.select(search.document_texts().alias("t")).select("t.*").na.fill("").collect()]
    for gram in ("the", "typ", "/ap", "😀 e"):
        assert n[gram] == sum(gram in t for t in texts)


@pytest.mark.parametrize("block", (1, 7, 1 << 22))
def test_grams_of_blocks(spark, block, monkeypatch):
    monkeypatch.setattr(text_index, "BLOCK", block)
    wide = ["".join(map(chr, range(0x4E00 + 700 * i, 0x4E00 + 700 * i + 900))) + "😀😀😀😀" + "".join(map(chr, range(0x20000 + 40_000 * (i % 2), 0x20000 + 40_000 * (i % 2) + 40_000))) for i in range(4)] + ["abcd"] * 5000  # numbers of 17 bits a character and 13 a text don't fit: halved
    for texts in (["", "ab", "abc", "abcabcab", "aaaa", "x😀y😀", "", "ñandú"], ["abababab"], [""], *([wide] if block > 7 else [])):
        got = {}
        for start, end in text_index._blocks(texts, text_index.np.zeros(len(texts), "int64")):
            for names, ends, places in text_index.block_grams(texts[start:end]):
                for i, name in enumerate(names):
                    got.setdefault(name, []).extend((places[ends[i]:ends[i + 1]] + start).tolist())
        assert got == {g: [i for i, t in enumerate(texts) if g in t] for g in {g for t in texts for g in text_index.grams(t)}} if texts is not wide else {g: v for g, v in got.items() if v != sorted(set(v))} == {}
        if texts is wide:
            assert sum(map(len, got.values())) == sum(len(text_index.grams(t)) for t in texts)
    if block > 7:
        counted = text_index.gram_counts(spark.createDataFrame([("a😀b😀b",), ("😀b😀",), (None,)], "text string"), "text")
        assert {r["gram"]: r["n"] for r in counted.collect()} == {"a😀b": 1, "😀b😀": 2, "b😀b": 1}
