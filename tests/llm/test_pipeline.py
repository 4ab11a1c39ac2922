"""The pipeline's stages, each against what it must do to its own input."""

import math
import zlib
from collections import Counter

import numpy as np

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def rows(df):
    return Counter(tuple(r) for r in df.select("doc_id", "text", "lang", "source").collect())


def test_stages_in_order(spark, tmp_path):
    from test_operators import brute_groups, words

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert out.columns == docs.columns
        kept.append((docs, out))
        docs = out

    before, after = kept[0]
    assert not rows(after) - rows(before)
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    left = {r["doc_id"] for r in after.collect()}
    sound = [d for d, q in labels.items() if q == 1 and len(words(next(r["text"] for r in before.collect() if r["doc_id"] == d))) >= 20]
    assert sum(d in left for d in sound) >= 0.95 * len(sound)

    before, after = kept[1]
    texts = {r["doc_id"]: r["text"] for r in before.collect()}
    seen = set()
    for r in sorted(after.collect(), key=lambda r: r["doc_id"]):
        lines = texts[r["doc_id"]].split("\n")
        assert set(r["text"].split("\n")) <= set(lines) and r["n_chars"] == len(r["text"])
        for x in r["text"].split("\n"):
            x = x.strip(" ").lower()
            assert len(x) < 20 or x not in seen
            seen.add(x)

    before, after = kept[2]
    want = [d for d, _, _, keep in brute_groups([(r["doc_id"], r["text"]) for r in before.collect()]) if keep]
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(want)
    assert not rows(after) - rows(before)

    before, after = kept[3]
    size, got = Counter(), Counter()
    for c, df in ((size, before), (got, after)):
        for r in df.collect():
            c[r["source"]] += len(words(r["text"]))
    assert sum(got.values()) <= sum(size.values()) and sum(got.values()) >= sum(size.values()) - len(size)
    assert all(got[s] <= 3 * size[s] for s in size)

    before, after = kept[4]
    from tokenizers import Tokenizer

    from quillmark.llm.packing import cut
    from quillmark.llm.shared import tokenizer_file

    tk = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    want = Counter()
    for r in before.collect():
        ids = [*tk.encode(r["text"], add_special_tokens=False).ids, 0]
        for k, (at, n) in enumerate(cut(len(ids), 2048)):
            want[(r["doc_id"], k, at, n, zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes()))] += 1
    found = after.collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found) == want
    assert len({r["sequence_id"] for r in found}) <= math.ceil(1.02 * sum(r["length"] for r in found) / 2048) + 1


def test_odd_tables(spark, tmp_path):
    """Null and empty texts, repeated rows, one id with two texts, columns with clashing names; and no rows at all."""
    ddl = "doc_id long, text string, lang string, source string, n_chars long, i int, exact string, taken int, marked boolean, key string"
    line = lambda k: " ".join(f"word{k}x{j} of" for j in range(30))
    data = [(0, None, None, None), (1, "", "en", "a"), (2, line(2), "en", "a"), (2, line(3), "en", "b"), (4, line(4), None, None), (4, line(4), None, None), (5, line(4), "de", "c"), (None, line(6), "de", "c")]
    docs = spark.createDataFrame([(*r, 0, 1, "x", 2, True, "k") for r in data], ddl)
    for table, texts in ((docs, sorted(map(line, (2, 3, 4, 6)))), (docs.limit(0), [])):
        now = table
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, now, "")
            if k < 4:
                assert out.columns == docs.columns
            path = str(tmp_path / f"{len(texts)}-{k}")
            out.write.parquet(path)
            now = spark.read.schema(out.schema).parquet(path)
            if k == 2:
                left = now.select("text", "marked", "key", "exact").collect()
                assert sorted(r["text"] for r in left) == texts and all(tuple(r)[1:] == (True, "k", "x") for r in left)
        assert now.filter("sequence_id is null or offset is null").count() == 0 and (now.count() > 0) == bool(texts)
