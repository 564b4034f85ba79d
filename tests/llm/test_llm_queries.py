"""Queries of the training-data operators against SQL or brute force over the whole small tables."""

import hashlib
import os
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from compare import connect, differences
from tokenizers import Tokenizer

import corpus_pipeline
from foliolens.llm import sketches
from foliolens.llm.expected_sql import SQL
from foliolens.llm.queries import QUERIES


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, sf_dir, name):
    assert differences(QUERIES[name](spark, sf_dir), connect(sf_dir), SQL[name]) == []


def test_there_is_one_query_per_operator():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))


def brute_simhash(text):
    words = "".join(c.lower() if c < "\x80" else c for c in text or "").translate(dict.fromkeys(range(9, 14), " ")).split(" ")
    words = [word for word in words if word]
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes) > 0)


def brute_components(prints):
    """``prints``: doc_id to fingerprint; the smallest reachable id of each."""
    found = {doc: doc for doc in prints}
    changed = True
    near = {a: [b for b in prints if (prints[a] ^ prints[b]).bit_count() <= 4] for a in prints}
    while changed:
        changed = False
        for doc, others in near.items():
            least = min(found[other] for other in others)
            if least < found[doc]:
                found[doc], changed = least, True
    return found


def test_simhash(spark, sf_dir, texts):
    prints = {doc_id: brute_simhash(text) for doc_id, text, _ in texts}
    groups = brute_components(prints)
    wanted = {(doc_id, f"{value:016x}", groups[doc_id]) for doc_id, value in prints.items()}
    assert {tuple(row) for row in QUERIES["op10_simhash"](spark, sf_dir).collect()} == wanted
    assert len(set(groups.values())) < len(groups)


def test_token_counts(spark, sf_dir, texts):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    wanted = set()
    for doc_id, text, _ in texts:
        count = len(library.encode(text or "", add_special_tokens=False).ids)
        wanted.add((doc_id, len((text or "").encode()), count, count > 512))
    assert {tuple(row) for row in QUERIES["op7_token_counts"](spark, sf_dir).collect()} == wanted


def test_sketches(spark, sf_dir, texts):
    ordered = sorted((doc_id, text or "") for doc_id, text, _ in texts)
    rows = {row.doc_id: row for row in QUERIES["op4_sketches"](spark, sf_dir).collect()}
    assert len(rows) == len(ordered)

    def kept(text):
        words = text.encode().lower().split()
        shingles = {b" ".join(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
        hashes = {xxhash.xxh3_64_intdigest(s) for s in shingles}
        return {h for h in hashes if h < 2**64 // sketches.SCALE} or set(sorted(hashes)[:1])

    def share(a, b):
        return len(a & b) / min(len(a), len(b)) if a and b else float(len(a) == len(b))

    for (doc_id, text), (_, following) in zip(ordered, ordered[1:] + ordered[:1]):
        half = len(text) // 2
        changed = text[: len(text) - half] + following[:half]
        row = rows[doc_id]
        assert (row.n_chars, row.edited_sha256) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
        assert row.fingerprint == "".join(f"{h:016x}" for h in sorted(kept(text)))
        assert row.near_edited == share(kept(text), kept(changed))
        assert row.near_next == share(kept(text), kept(following))


def test_toxicity(spark, sf_dir, texts):
    rows = QUERIES["op2_toxicity"](spark, sf_dir).collect()
    assert sorted(row.doc_id for row in rows) == sorted(doc_id for doc_id, _, _ in texts)
    for row in rows:
        assert row.held_out == (zlib.crc32(str(row.doc_id).encode()) % 4 == 2)
        assert 0 <= row.score <= 1 and row.predicted == int(row.score >= 0.3)


def test_toxicity_of_rows_held_out(spark, sf_dir):
    """On the larger table, which has enough toxic rows among those that teach nothing."""
    larger = os.path.join(os.path.dirname(sf_dir), "sf0.1")
    if not os.path.exists(larger):
        pytest.skip("no larger table")
    labels = spark.read.parquet(f"{larger}/labels.parquet").filter("toxic in (0, 1)")
    rows = QUERIES["op2_toxicity"](spark, larger).filter("held_out").join(labels, "doc_id").select("score", "predicted", "toxic").collect()
    toxic, clean = ([row for row in rows if row.toxic == kind] for kind in (1, 0))
    ahead = np.mean([[t.score > c.score for c in clean] for t in toxic])
    assert ahead >= 0.95
    assert np.mean([row.predicted for row in toxic]) >= 0.75 and np.mean([row.predicted for row in clean]) <= 0.01


def brute_pipeline(spark, sf_dir, texts, scores):
    docs = [(doc_id, text, source) for doc_id, text, source in texts if scores[doc_id] < 0.3]

    def key(line):
        own = line.encode().strip(b" \t\n\x0b\x0c\r").lower().decode()
        return own if len(own) >= 20 else None

    holders = {}
    for doc_id, text, _ in docs:
        for own in {key(line) for line in (text or "").split("\n")} - {None}:
            holders.setdefault(own, set()).add(doc_id)
    gone = {own: max(held) for own, held in holders.items() if len(held) >= 3}
    docs = [
        (doc_id, "\n".join(l for l in text.split("\n") if gone.get(key(l), doc_id) == doc_id), source)
        for doc_id, text, source in docs
    ]
    groups = brute_components({doc_id: brute_simhash(text) for doc_id, text, _ in docs})
    docs = [doc for doc in docs if groups[doc[0]] == doc[0]]
    clean = {row.doc_id for row in spark.createDataFrame(docs, "doc_id bigint, text string, source string").select("doc_id").collect()}
    connection = connect(sf_dir)
    connection.execute("CREATE OR REPLACE TEMP TABLE kept(doc_id BIGINT, text VARCHAR)")
    connection.executemany("INSERT INTO kept VALUES (?, ?)", [doc[:2] for doc in docs])
    sql = SQL["op1_decontamination"].replace("FROM documents\n", "FROM kept\n")
    clean -= {row[0] for row in connection.execute(f"SELECT doc_id FROM ({sql}) WHERE contaminated").fetchall()}
    docs = [doc for doc in docs if doc[0] in clean]
    connection.execute("CREATE OR REPLACE TEMP TABLE mixed(doc_id BIGINT, text VARCHAR, source VARCHAR)")
    connection.executemany("INSERT INTO mixed VALUES (?, ?, ?)", docs)
    sql = SQL["op8_mixing"].replace("AS size FROM documents", "AS size FROM mixed")
    return {doc[0]: doc[1] for doc in docs}, set(connection.execute(f"SELECT doc_id, size, source_size, target, taken FROM ({sql}) WHERE taken > 0").fetchall())


def test_pipeline(spark, sf_dir, texts):
    from foliolens.llm import toxicity
    from foliolens.llm.queries import held_out
    from pyspark.sql import functions as F

    documents, labels = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "labels"))
    scored = toxicity.scored(documents, labels.filter(~held_out(F.col("doc_id"))))
    scores = {row.doc_id: row.score for row in scored.select("row.doc_id", "score").collect()}
    kept, wanted = brute_pipeline(spark, sf_dir, texts, scores)
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns[: len(documents.columns)] == documents.columns
    rows = out.collect()
    assert {(r.doc_id, r.size, r.source_size, r.target, r.taken) for r in rows} == wanted
    assert all(r.text == kept[r.doc_id] for r in rows)
    assert np.all(np.diff([r.position for r in rows]) >= 0)


def test_every_stage_but_the_last_keeps_the_columns(spark, sf_dir, odd):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd, sf_dir).columns == odd.columns, name
