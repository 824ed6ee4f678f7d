"""The pipeline against plain Python, and every registered query on an empty and a small input."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from millrace.llm import queries

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text.translate(LOWER))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_pipeline(rows, items):
    """Ids that remain, by the definitions of the stages."""
    docs = {i: t for i, t in rows if t and re.search(r"[^\W\d_]", t)}
    last = {}
    for i in sorted(docs):
        last[docs[i].translate(LOWER)] = i
    docs = {i: docs[i] for i in sorted(last.values())}
    sets, label = {i: shingles(t) for i, t in docs.items()}, {}
    holders = {}
    for i in sorted(docs):
        label[i] = i
        for s in sets[i]:
            holders.setdefault(s, []).append(i)
    parent = dict(label)

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in docs:
        for j in {j for s in sets[i] for j in holders[s] if j < i}:
            if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    docs = {i: t for i, t in docs.items() if root(i) == i}
    return {i for i, t in docs.items() if not any(item.lower() in t.lower() for item in items)}


def test_pipeline_equals_brute_force(spark, tmp_path):
    source, rng = "/root/testdata/sf0.001", random.Random(1)
    docs, bench = (spark.read.parquet(f"{source}/{t}.parquet") for t in ("documents", "benchmark"))
    more = [(10_000, None, "en", "s", 0), (10_001, "", None, "s", 0), (10_002, "12 34", "en", "s", 5), (10_003, docs.first().text.upper(), None, None, 1)]
    noise = [" ".join("".join(rng.choice("bcdfghjklmnpqrstvwxyz") for _ in range(8)) for _ in range(50)) for _ in range(3)]
    more += [(10_010 + k, t, None, "s", 0) for k, t in enumerate([*noise, "съешь ещё этих мягких французских булок да выпей же чаю " * 9])]
    docs = docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(spark.createDataFrame(
        more, "doc_id long, text string, lang string, source string, n_chars long"
    ))
    folder = f"file://{tmp_path}/in"
    docs.write.parquet(f"{folder}/documents.parquet")
    bench.write.parquet(f"{folder}/benchmark.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    foreign = set(range(10_010, 10_014))  # of no language in the labels
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, folder).collect()}
    assert set(out) == brute_pipeline([r for r in rows if r[0] not in foreign], [r.text for r in bench.collect()])
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = dict(rows)
    for i, r in out.items():
        assert list(r.piece_ids) == library.encode(texts[i]) and r.decoded == texts[i]


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(20)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, "/root/testdata/sf0.001").columns == docs.columns


def test_stages_carry_clashing_names_and_odd_rows(spark):
    names = ["gone", "kept", "lang_pred", "fits", "id", "item_ids", "number", "row"]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) < 2000").limit(12)
    odd = spark.createDataFrame(
        [(None, None, "en", "s", 0), (None, "same words here", None, "s", 1), (7_000, "", "en", "s", 2), (7_000, "other words there", None, "s", 3)],
        "doc_id long, text string, lang string, source string, n_chars long"
    )
    docs = docs.select(*odd.columns).unionByName(odd)
    for k, name in enumerate(names):
        docs = docs.withColumn(name, F.lit(k))
    for _, stage in corpus_pipeline.STAGES:
        before = docs.columns
        docs = stage(spark, docs, "/root/testdata/sf0.001")
        assert docs.columns[: len(before) - 1] == [c for c in before if c != "text"] or docs.columns == before
    out = docs.collect()
    assert all(r[n] == k for r in out for k, n in enumerate(names))
    assert [r.decoded for r in out if r.doc_id is None] == ["same words here"] and [r.decoded for r in out if r.doc_id == 7_000] == ["other words there"]


def test_queries_on_empty_tables(spark, tmp_path):
    folder = f"file://{tmp_path}/none"
    for t in ("documents", "benchmark", "labels", "conversations"):
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").limit(0).write.parquet(f"{folder}/{t}.parquet")
    for name, query in queries.QUERIES.items():
        assert query(spark, folder).count() == (1 if name.startswith("op9_") else 0), name


def test_registered_queries_equal_the_libraries(spark):
    """op3, op4, op5 and op9 as registered, over the small tables."""
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    ids = sorted(texts)
    bpe = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encoded = dict(zip(ids, (x.ids for x in bpe.encode_batch([texts[i] for i in ids], add_special_tokens=False))))
    pieces = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    crc = lambda own: zlib.crc32(np.array(own, dtype="<u4").tobytes())
    start, truth = 0, {}
    for i in ids:
        truth[i] = (start, len(encoded[i]) + 1, crc([*encoded[i], 0]))
        start += len(encoded[i]) + 1
    run = lambda name: queries.QUERIES[name](spark, folder).collect()
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in run("op3_token_files")} == truth
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in run("op5_token_counts")} == {i: (len(texts[i].encode()), len(encoded[i]), len(encoded[i]) > 512) for i in ids}
    own = {i: pieces.encode(texts[i]) for i in ids}
    assert {r.doc_id: (r.n_pieces, r.ids_crc32, r.round_trip) for r in run("op4_sentencepiece")} == {i: (len(own[i]), crc(own[i]), True) for i in ids}
    turns, both = {}, "<|im_end|><|im_start|>assistant ok"
    for r in spark.read.parquet(f"{folder}/conversations.parquet").orderBy("conv_id", "turn").collect():
        turns.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    turns[-1] = [("user", both), ("assistant", both)]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    said = {c: "".join(t for role, t in rows if role == "assistant") for c, rows in turns.items()}
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in run("op9_chat_format")} == {
        c: (len(rows), sha("".join(f"{role}\n{t}\n" for role, t in rows)), len(said[c]), sha(said[c])) for c, rows in turns.items()}


def test_queries_leave_the_session_as_it_is(spark):
    import __spark_entry__

    before = spark.conf.getAll
    for name, query in __spark_entry__.queries().items():
        if name.startswith("op") or name == "pipeline":
            query(spark, "/root/testdata/sf0.001")
    assert spark.conf.getAll == before


def test_recall_of_near_duplicates_is_whole(spark):
    """Every linked pair of the small table by brute force is in one group."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    group = {r.doc_id: r.component_id for r in queries.QUERIES["op10_minhash_near_dedup"](spark, "/root/testdata/sf0.001").collect()}
    sets = {r.doc_id: shingles(r.text or "") for r in docs.collect()}
    holders, links = {}, set()
    for i, own in sets.items():
        for s in own:
            holders.setdefault(s, []).append(i)
    for i, own in sets.items():
        for j in {j for s in own for j in holders[s] if j < i}:
            if 100 * len(own & sets[j]) >= 75 * len(own | sets[j]):
                links.add((i, j))
    assert links and all(group[i] == group[j] for i, j in links)
