"""Defined results on small fixtures: odd rows, empty tables, and what the methods promise."""

import gzip

import numpy as np
import pytest
from conftest import COPIED, ODD_ROWS
from pyspark.sql import functions as F

from foliolens.llm import (
    chat, decontamination, license_scan, license_templates, license_texts, line_dedup, mixing, simhash, sketches,
    token_counts, toxicity, warc,
)

BENCHMARK = "item_id bigint, text string"


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(
        [(1, 0), (2, 1), (None, 1), (7, None), (8, 1), (8, 0), (99, 1)], "doc_id bigint, toxic int"
    )


# --- decontamination


def test_contamination_of_odd_rows(spark, odd):
    items = spark.createDataFrame(
        [(1, COPIED), (2, COPIED), (None, COPIED), (3, None), (4, ""), (5, "few WORDS"), (6, "not there at all")], BENCHMARK
    )
    rows = decontamination.contamination(odd, items).select("row.doc_id", "n_words", "n_hit", "item_ids", "contaminated").collect()
    assert len(rows) == len(ODD_ROWS)
    by_id = {row.doc_id: row for row in rows}
    assert (by_id[7].n_words, by_id[7].n_hit, by_id[7].item_ids, by_id[7].contaminated) == (18, 14, ["1", "2"], True)
    assert [r.n_hit for r in rows if r.doc_id == 7] == [14, 14]
    assert (by_id[1].n_hit, by_id[1].item_ids) == (2, ["5"]) and by_id[None].n_hit == 2
    assert (by_id[2].n_words, by_id[2].n_hit, by_id[3].contaminated, by_id[4].n_words) == (0, 0, False, 0)
    assert by_id[6].n_words == 15_000 * 5


def test_a_twentieth_of_the_words(spark):
    words = COPIED.split()[:13]
    texts = [(1, " ".join([*words, *["x"] * 247])), (2, " ".join([*words, *["x"] * 248]))]
    documents = spark.createDataFrame(texts, "doc_id bigint, text string")
    items = spark.createDataFrame([(1, COPIED)], BENCHMARK)
    assert [r.doc_id for r in decontamination.decontaminate(documents, items).collect()] == [2]


def test_proximity(spark):
    documents = spark.createDataFrame([(1, "alpha then beta soon gamma"), (2, "alpha q q q q beta gamma")], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "alpha beta gamma")], BENCHMARK)
    exact = decontamination.phrase_matches(documents, items).filter(F.size("matches") > 0)
    near = decontamination.phrase_matches(documents, items, slop=2).filter(F.size("matches") > 0)
    assert exact.count() == 0
    assert [r.doc_id for r in near.select("row.doc_id").collect()] == [1]


def test_empty_tables(spark, odd, none, labels):
    items = spark.createDataFrame([], BENCHMARK)
    assert decontamination.decontaminate(odd, items).count() == len(ODD_ROWS)
    assert decontamination.contamination(none, spark.createDataFrame([(1, COPIED)], BENCHMARK)).count() == 0
    assert toxicity.scored(none, labels).count() == 0
    assert max(r.score for r in toxicity.scored(odd, labels.limit(0)).collect()) < 1e-6
    assert line_dedup.dedup_lines(none).count() == 0
    assert sketches.with_next(none).count() == 0
    assert license_scan.scan_licenses(none).count() == 0
    assert mixing.mix(none).count() == 0 and mixing.curriculum(none).count() == 0
    assert simhash.components(none).count() == 0 and simhash.deduplicated(none).count() == 0


# --- toxicity


def test_scores_of_odd_rows(odd, labels):
    rows = toxicity.scored(odd, labels).select("row.doc_id", "score").collect()
    assert len(rows) == len(ODD_ROWS) and all(0 <= row.score <= 1 for row in rows)


def test_pairs_count_for_more_than_their_parts():
    random = np.random.default_rng(1)
    rows, labels = [], []
    for i in range(2000):
        insult, group = i % 2, i // 2 % 2
        own = {*random.integers(10, 60, 8).tolist(), *([1] if insult else []), *([2] if group else [])}
        rows.append(np.array(sorted(own), dtype=np.int32))
        labels.append(insult == group)  # no sum of single weights tells these apart
    model = toxicity.fit(rows, np.array(labels, dtype=float), 0.5)
    scores = model.scores(rows)
    assert ((scores > 0.5) == np.array(labels)).mean() > 0.95


def test_pairs_of_rare_terms_that_tell_nothing_alone():
    """Two terms, each in 4 % of the rows and both in 2 %: toxic together, harmless apart."""
    random = np.random.default_rng(2)
    rows, labels = [], []
    for i in range(6000):
        kind = i % 50
        own = set(random.integers(10, 200, 8).tolist())
        own |= {0: {1, 2}, 1: {1}, 2: {2}}.get(kind, set())
        rows.append(np.array(sorted(own), dtype=np.int32))
        labels.append({0: 1.0, 1: 0.0, 2: 0.0}.get(kind, float(random.random() < 0.3)))
    labels = np.array(labels)
    owner = np.repeat(np.arange(len(rows)), [len(row) for row in rows])
    terms, inverse = np.unique(np.concatenate(rows), return_inverse=True)
    total, bad = np.bincount(inverse).astype(float), np.bincount(inverse, labels[owner])
    assert set(terms[toxicity.telling_pairs(inverse, owner, labels, total, bad)].tolist()) == {1, 2}
    model = toxicity.fit(rows, labels, float(labels.mean()))
    scores = model.scores([np.array(own, np.int32) for own in ([1, 2], [1], [2])])
    assert scores[0] > 0.6 and max(scores[1:]) < 0.25


def test_margins_are_those_of_a_double_loop():
    random = np.random.default_rng(3)
    terms = np.unique(random.integers(0, 500, 60)).astype(np.int32)
    weights, factors = random.normal(size=len(terms)), random.normal(size=(len(terms), 4))
    model = toxicity.Model(0.3, terms, weights, factors)
    place = {int(term): i for i, term in enumerate(terms)}
    rows = [np.unique(random.integers(0, 500, n)).astype(np.int32) for n in (0, 1, 2, 30, 200)]
    for row, margin in zip(rows, model.margins(rows)):
        held = [place[int(term)] for term in row if int(term) in place]
        wanted = 0.3 + sum(weights[i] for i in held)
        wanted += sum(float(factors[i] @ factors[j]) for n, i in enumerate(held) for j in held[n + 1:])
        assert abs(margin - wanted) < 1e-9


# --- lines


def test_lines_of_odd_rows(odd):
    rows = {r.doc_id: r for r in line_dedup.dedup_lines(odd).select("row.doc_id", "n_lines", "n_dropped", "kept").collect()}
    assert (rows[8].n_lines, rows[8].n_dropped, rows[8].kept) == (3, 2, "short")
    assert (rows[9].n_lines, rows[9].n_dropped, rows[9].kept) == (4, 0, "\r\na line that is long enough to count.\n\n")
    assert (rows[1].n_dropped, rows[2].n_lines, rows[2].kept, rows[3].n_lines) == (1, 1, None, 1)


def test_a_filter_that_is_full_loses_nothing(odd, monkeypatch):
    wanted = sorted(map(str, line_dedup.deduplicated(odd).collect()))
    monkeypatch.setattr(line_dedup.Filter, "places", staticmethod(
        lambda hashes, words: (np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.uint64))
    ))
    assert sorted(map(str, line_dedup.deduplicated(odd).collect())) == wanted


# --- sketches


def test_sketches_of_odd_rows(odd):
    rows = sketches.with_next(odd).collect()
    assert len(rows) == len(ODD_ROWS)
    twice = [row for row in rows if row.doc_id == 7]
    assert twice[0].fingerprint == twice[1].fingerprint and 1.0 in {row.near_next for row in twice}
    empty = next(row for row in rows if row.doc_id == 2)
    assert (empty.n_chars, empty.fingerprint, empty.near_edited, empty.near_next) == (0, "", 1.0, 1.0)


def test_ranges_do_not_change_the_result(odd, monkeypatch):
    wanted = sorted(map(str, sketches.with_next(odd).collect()))
    monkeypatch.setattr(sketches, "RANGE_ROWS", 2)
    assert sorted(map(str, sketches.with_next(odd).collect())) == wanted


def test_sketches_merge():
    one, two = " ".join(f"a{i}" for i in range(400)), " ".join(f"b{i}" for i in range(900))
    a, b = sketches.hashes(one), sketches.hashes(two)
    both = sketches.merged(a, b)
    assert sketches.containment(a, both) == 1.0 and sketches.containment(a, b) == 0.0
    part = sketches.hashes(" ".join(one.split()[:200] + two.split()))
    assert 0.3 < sketches.containment(a, part) < 0.7


# --- licenses


def test_license_parts(spark):
    texts = ["x\n  RELEASED under the MIT license \ny", "Licensed under CC BY-NC 4.0", None, "", "word",
             "This is free and unencumbered\nsoftware released into\nthe public domain."]
    documents = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    rows = {r.doc_id: r for r in license_scan.scan_licenses(documents).select("row.doc_id", "licenses", "matches").collect()}
    assert [rows[i].licenses for i in range(6)] == [["MIT"], ["CC-BY-NC-4.0"], [], [], [], ["Unlicense"]]
    assert (rows[0].matches[0].part, rows[0].matches[0].number, rows[5].matches[0].part) == ("line", 1, "block")


def test_size_bounds_lose_nothing():
    templates = license_scan.Templates(license_scan.TEMPLATES, 0.8)
    loose = license_scan.Templates(license_scan.TEMPLATES, 1e-6)
    for _, text in license_scan.TEMPLATES:
        words = license_scan.words(text.encode())
        for cut in range(2, len(words) + 1):
            best, any_ = templates.best(words[:cut]), loose.best(words[:cut])
            assert best == (any_ if any_ and any_[0] >= 0.8 else None)


def test_notices_inside_longer_texts(spark):
    texts = [
        "The töol is free to use. Released under the MIT License. See the site for more.",
        "Released under the MIT License. Copyright 2020 Jane Doe",
        "# Copyright 2020 Jane Doe\n# This work is licensed under a Creative\n# Commons Attribution 4.0\n#\n# International License.\nx = 1",
        "Released under the MIT License. Some more words. Licensed under CC BY-NC 4.0. " * 2,
        "the license of the MIT under which nothing was released", None, "word", f"Some words. {dict(license_templates.MORE_NOTICES)['GPL-2.0']} More.",
    ]
    documents = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = {r.doc_id: r for r in license_scan.scan_licenses(documents).select("row.doc_id", "span_licenses", "spans").collect()}
    assert [rows[i].span_licenses for i in range(8)] == [
        ["MIT"], ["MIT"], ["CC-BY-4.0"], ["CC-BY-NC-4.0", "MIT"], [], [], [], ["GPL-2.0"]
    ]
    given = [texts[0][s.start:s.end] for s in rows[0].spans]
    assert given == ["Released under the MIT License"] and rows[0].spans[0].dice == 1.0
    assert [s.license for s in rows[3].spans] == ["MIT", "CC-BY-NC-4.0"] * 2


@pytest.mark.parametrize("name, text", license_texts.FULL_TEXTS)
def test_full_texts(name, text):
    """Each in numbered blocks, with a copyright line and between other words."""
    runs = license_scan.Runs(license_scan.TEMPLATES + license_scan.MORE_NOTICES + license_texts.FULL_TEXTS, 0.8)
    planted = "Copyright (c) 2020 Jane Doe\n\n" + text.replace(". ", ".\n\n") + "\n\nOther words follow it here."
    found = license_scan.spans(planted, runs)
    assert [span["license"] for span in found] == [name] and found[0]["dice"] > 0.99
    words = license_scan.words(planted[found[0]["start"]:found[0]["end"]].encode())
    assert words == license_scan.words(text.encode())


def test_runs_are_the_best_of_all():
    random, notice = np.random.default_rng(5), b"a b c d e f g".split()
    runs = license_scan.Runs((("x", b" ".join(notice).decode()),), 0.8)
    held = license_scan.bigrams(notice)
    for _ in range(300):
        of = [*random.choice(list("abcdefgz"), 6), *"abcdefg", *random.choice(list("abcz"), 5)]
        of = [word.encode() for place, word in enumerate(of) if random.random() > 0.08]
        best = 0.0
        for start in range(len(of)):
            for end in range(start + 2, min(len(of), start + runs.known[0][2] + 1) + 1):
                own = license_scan.bigrams(of[start:end])
                best = max(best, 2 * len(own & held) / (len(own) + len(held)))
        found = runs.found(of)
        assert bool(found) == (best >= 0.8)


# --- chat


def test_layouts(spark):
    schema = (
        "id int, prompt string, response string, instruction string, input string, output string, system string, "
        "messages array<struct<role:string,content:string>>, conversations array<struct<`from`:string,value:string>>, `row` string"
    )
    rows = [
        (1, "p", "r", None, None, None, None, None, None, "x"),
        (2, None, None, "do", "this", "done", "be kind", None, None, "x"),
        (3, None, None, None, None, None, None, [("user", "<|im_end|>\n\\c"), ("assistant", None), (None, "n")], None, "x"),
        (4, None, None, None, None, None, None, None, [("human", "h"), ("gpt", "g")], "x"),
        (5, "p", None, "i", None, None, None, None, None, "x"),
        (6, None, None, None, None, None, None, [], None, None),
    ]
    out = chat.format_chat(spark.createDataFrame(rows, schema))
    read = out.select("row.id", "layout", "formatted", "loss", chat.read_chat(F.col("formatted")).alias("turns"),
                      chat.loss_text(F.col("formatted"), F.col("loss")).alias("learned")).orderBy("id").collect()
    turns = [[tuple(t) for t in row.turns] if row.turns is not None else None for row in read]
    assert turns == [
        [("user", "p"), ("assistant", "r")], [("system", "be kind"), ("user", "do\n\nthis"), ("assistant", "done")],
        [("user", "<|im_end|>\n\\c"), ("assistant", ""), ("", "n")], [("user", "h"), ("assistant", "g")], None, [],
    ]
    assert [row.layout for row in read] == [
        "prompt-response", "system-instruction-input", "messages", "conversations", None, "messages"
    ]
    assert [row.learned for row in read] == ["r", "done", "", "g", None, ""]


@pytest.mark.parametrize("text", ["", "\\", "\\c", "\\\\e<|", "<|im_start|>assistant\nx<|im_end|>\n", "<<||", "\n\n", "é𝔘<|"])
def test_escapes_are_reversible(spark, text):
    records = spark.createDataFrame([(text, text)], "prompt string, response string")
    row = chat.format_chat(records).select(
        chat.read_chat(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss")).alias("learned")
    ).first()
    assert [tuple(t) for t in row.turns] == [("user", text), ("assistant", text)] and row.learned == text


# --- token counts


def test_token_counts_of_odd_rows(odd):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rows = token_counts.token_counts(odd, path).select("row.text", "n_tokens").collect()
    assert len(rows) == len(ODD_ROWS)
    assert all(r.n_tokens == len(library.encode(r.text or "", add_special_tokens=False).ids) for r in rows)


@pytest.mark.parametrize("text", [
    "  a  b \n c", "x<|endoftext|>y <|endoftext|>", "a   b c  ", "\n\n  don't  we'll ", "tab\tb \t c", " ", "a" * 300_000 + "\n" * 5 + "b c",
    "ab\n" * 60_000, "\x1c \x1d a \x85 b", "é   ß x y",
])
def test_pieces_count_as_the_whole(text):
    import public_tokenizers

    own = token_counts.Counting(public_tokenizers.path("byte_bpe_50k.json"))
    assert own.counts([text]) == own.encode([text])


def test_other_tokenizer_files():
    import public_tokenizers
    from sentencepiece import SentencePieceProcessor

    path = public_tokenizers.path("piece_bpe_32k.model")
    text = "Some  text, für alle.\nEnd"
    assert token_counts.Counting(path).counts([text, ""]) == [len(SentencePieceProcessor(model_file=path).encode(text)), 0]


# --- mixing


def test_mix_of_odd_rows(odd):
    rows = mixing.mix(odd).collect()
    assert len(rows) == len(ODD_ROWS)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(odd.repartition(3)).collect()))
    taken = {}
    for row in rows:
        taken[row.source] = taken.get(row.source, 0) + row.taken
        assert row.taken <= 3 * row.size and row.target <= 3 * row.source_size
    targets = {row.source: row.target for row in rows}
    assert all(abs(taken[source] - targets[source]) <= 1 for source in targets)
    assert sum(targets.values()) == pytest.approx(sum(row.size for row in rows))
    assert mixing.curriculum(odd).count() == sum(row.taken > 0 for row in rows)


def test_time_inverts_the_integral(spark):
    frame = spark.range(101).select((F.col("id") / 100).alias("share"), F.array(F.lit(1.0), F.lit(3.0), F.lit(0.0)).alias("s"))
    rows = frame.select("share", mixing.training_time(F.col("s"), F.col("share")).alias("time"), mixing.integral(F.col("s")).alias("area")).collect()
    grid = np.linspace(0, 1, 100_001)
    height = np.interp(grid, [0, 0.5, 1], [1, 3, 0])
    used = np.concatenate(([0], np.cumsum((height[1:] + height[:-1]) / 2 * np.diff(grid))))
    assert rows[0].area == pytest.approx(used[-1])
    for row in rows:
        assert row.time == pytest.approx(np.interp(row.share * used[-1], used, grid), abs=1e-3)


def test_later_weights_place_later(spark):
    documents = spark.createDataFrame([(i, "a b c", "early" if i % 2 else "late") for i in range(200)], "doc_id bigint, text string, source string")
    schedules = spark.createDataFrame([("early", [2.0, 0.0]), ("late", [0.0, 2.0])], "source string, schedule array<double>")
    means = {r.source: r.mean for r in mixing.mix(documents, schedules).groupBy("source").agg(F.avg("position").alias("mean")).collect()}
    assert means["early"] < 0.4 < 0.6 < means["late"]


def test_every_pass_has_its_place(spark):
    rows = [(i, "a b c", "small") for i in range(10)] + [(100 + i, "a b c", "large") for i in range(90)]
    documents = spark.createDataFrame(rows + [(-1, "", "small")], "doc_id bigint, text string, source string")
    schedules = spark.createDataFrame([("small", [1.0, 1.0]), ("large", [3.0, 3.0])], "source string, schedule array<double>")
    order = mixing.training_order(documents, schedules).collect()
    own = [r for r in order if r.source == "small"]
    # 75 of 300 words from 30: two whole passes and half of a third, evenly over the time.
    assert [sum(r.words for r in own if r["pass"] == n) for n in (1, 2, 3)] == [30, 30, 15]
    assert [r.position for r in own] == pytest.approx([i * 3 / 75 for i in range(25)])
    assert [r.doc_id for r in own[:10]] == [r.doc_id for r in own[10:20]]
    taken = {}
    for row in order:
        taken[row.doc_id] = taken.get(row.doc_id, 0) + row.words
    assert all(taken[r.doc_id] == r.taken for r in order) and sum(taken.values()) == 300
    assert all(a.position <= b.position for a, b in zip(order, order[1:]))
    passes = {r.doc_id: [p.position for p in r.passes] for r in mixing.curriculum(documents, schedules).collect()}
    assert passes == {doc: [r.position for r in order if r.doc_id == doc] for doc in taken}


# --- WARC


PAGES = [(3, "https://e.org/3", "same"), (1, "https://e.org/1", "same"), (2, None, None), (5, "u\r\nX: y", ""), (None, "n", "same"),
         (9, "https://o.org/", "WARC/1.1\r\n\r\nünï")]


@pytest.fixture(scope="module")
def archive(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('warc')}/a"
    warc.write_archive(spark.createDataFrame(PAGES, "page_id bigint, url string, html string").repartition(3), path)
    return path


def test_round_trip(spark, archive):
    rows = {r.page_id: r for r in warc.read_archive(spark, archive, verify=True).collect()}
    assert {k: (r.record_type, r.refers_to, r.payload) for k, r in rows.items()} == {
        1: ("response", None, "same"), 3: ("revisit", 1, None), None: ("revisit", 1, None), 2: ("response", None, ""),
        5: ("revisit", 2, None), 9: ("response", None, "WARC/1.1\r\n\r\nünï"),
    }
    assert (rows[3].payload_bytes, rows[3].payload_digest) == (4, warc.digest(b"same")) and rows[5].url == "u%0D%0AX: y"


def test_predicates_are_pushed_and_payloads_skipped(spark, archive, monkeypatch):
    revisits = warc.read_archive(spark, archive, "page_id bigint, record_type string").filter("record_type = 'revisit'")
    assert revisits.count() == 3
    assert "Filter" not in revisits._jdf.queryExecution().executedPlan().toString().split("BatchScan")[0]
    read = []
    stream = __import__("io").BytesIO(warc.record(1, "u", b"x" * 100, "response", None))
    stream.read = lambda n, own=stream.read: read.append(n) or own(n)
    assert len(list(warc.read_records(stream, lambda row: True, False, False))) == 1 and read == []


def test_other_archives(spark, tmp_path):
    data = b"".join(gzip.compress(warc.record(i, f"u{i}", b"p%d" % i, "response", None)) for i in range(3))
    (tmp_path / "x.warc.gz").write_bytes(data + gzip.compress(b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 2\r\n\r\nab\r\n\r\n"))
    rows = warc.read_archive(spark, str(tmp_path)).orderBy("page_id").collect()
    assert [(r.page_id, r.record_type, r.payload) for r in rows][1:] == [(0, "response", "p0"), (1, "response", "p1"), (2, "response", "p2")]


def test_a_damaged_payload_is_noticed(spark, tmp_path):
    (tmp_path / "x.warc").write_bytes(warc.record(1, "u", b"good", "response", None).replace(b"good", b"evil"))
    with pytest.raises(Exception, match="does not match its digest"):
        warc.read_archive(spark, str(tmp_path), verify=True).collect()


# --- SimHash


def test_simhash_of_odd_rows(odd):
    rows = simhash.components(odd).collect()
    assert len(rows) == len(ODD_ROWS)
    by_id = {row.doc_id: row for row in rows}
    assert by_id[2].fp == by_id[3].fp == by_id[4].fp == 0 and by_id[4].component_id == 2
    kept = sorted(r.doc_id for r in simhash.deduplicated(odd).select("doc_id").collect() if r.doc_id is not None)
    assert kept == sorted({row.component_id for row in rows if row.component_id is not None})


def test_groups_with_equal_or_no_ids_all_stay(spark):
    texts = {name: " ".join(f"{name}{i}" for i in range(60)) for name in "uvwxyz"}
    rows = [(None, texts["u"]), (None, texts["v"]), (None, texts["w"]), (None, texts["w"]),
            (5, texts["x"]), (5, texts["y"]), (6, texts["x"]), (7, texts["y"]), (8, texts["z"]), (None, texts["z"])]
    documents = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    kept = [tuple(row) for row in simhash.deduplicated(documents).collect()]
    wanted = [(None, texts["u"]), (None, texts["v"]), (None, texts["w"]), (5, texts["x"]), (5, texts["y"]), (8, texts["z"])]
    assert sorted(kept, key=lambda row: row[1]) == wanted


def random_prints(count, seed=3):
    random = np.random.default_rng(seed)
    centres = random.integers(0, 2**64, count // 4, dtype=np.uint64)
    near = centres[random.integers(0, len(centres), count)]
    for _ in range(5):
        near ^= np.uint64(1) << random.integers(0, 64, count, dtype=np.uint64)
    return np.unique(np.concatenate([centres, near]))


def brute_groups(prints):
    label = np.arange(len(prints))
    linked = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 4
    while True:
        least = np.where(linked, label[None, :], len(prints)).min(1)
        if (least == label).all():
            return label
        label = least


@pytest.mark.parametrize("count, cell", [(10, 8192), (10**9, 8192), (10, 16)])
def test_shards_lose_no_link(spark, monkeypatch, count, cell):
    """With few and many blocks, and with shards cut into parts."""
    monkeypatch.setattr(simhash, "CELL_ROWS", cell)
    prints = random_prints(600)
    frame = spark.createDataFrame([(int(v),) for v in prints.view(np.int64)], "fp bigint")
    roots = {r.node: r.root for r in simhash.connected(simhash.links(frame, count)).collect()}
    wanted = brute_groups(prints)
    own = np.array([roots.get(int(v), int(v)) for v in prints.view(np.int64)])
    assert len(set(zip(own.tolist(), wanted.tolist()))) == len(set(own.tolist())) == len(set(wanted.tolist()))


def test_bk_trees_find_all_neighbours():
    prints = random_prints(400)
    group = np.zeros(len(prints), np.int64)
    trees = simhash.Trees(prints, group)
    found = {(int(q), int(n)) for qs, ns in trees.search(prints, np.zeros(len(prints), np.int64), 4) for q, n in zip(qs, ns)}
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 4
    assert found == set(zip(*(side.tolist() for side in np.nonzero(near))))


def test_long_chains_connect(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)], "a bigint, b bigint")
    assert {r.root for r in simhash.connected(edges).collect()} == {0}


# --- faults of earlier rounds


def test_conversations_of_any_number_of_turns(spark):
    rows = [(1, 0, "user", "hi"), (2, 0, "assistant", None), (3, 0, "user", "q"), (3, 1, "assistant", "a"),
            (4, 0, "assistant", "a"), (4, 1, "user", "q"), (5, None, None, "x"), (5, 1, "user", "y"), (None, 0, "user", "n")]
    records = chat.from_rows(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
    out = chat.format_chat(records).select("row.conv_id", "layout", chat.read_chat(F.col("formatted")).alias("turns"))
    found = {r.conv_id: (r.layout, [tuple(t) for t in r.turns]) for r in out.collect()}
    assert found == {
        1: ("messages", [("user", "hi")]), 2: ("messages", [("assistant", "")]),
        3: ("prompt-response", [("user", "q"), ("assistant", "a")]), 4: ("messages", [("assistant", "a"), ("user", "q")]),
        5: ("messages", [("", "x"), ("user", "y")]), None: ("messages", [("user", "n")]),
    }
    none = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert chat.format_chat(chat.from_rows(none)).count() == 0


def test_archives_grow_by_each_write(spark, tmp_path):
    path = f"file://{tmp_path}/a"
    pages = [spark.createDataFrame([(i, f"u{i}", f"p{i}")], "page_id bigint, url string, html string") for i in range(4)]
    for frame in pages[:3]:
        warc.write_archive(frame, path)
    assert sorted(r.page_id for r in warc.read_archive(spark, path).collect()) == [0, 1, 2]
    warc.write_archive(pages[0].limit(0), path)
    assert warc.read_archive(spark, path).count() == 3
    warc.write_archive(pages[3], path, mode="overwrite")
    assert [r.page_id for r in warc.read_archive(spark, path).collect()] == [3]
    warc.write_archive(pages[0].limit(0), f"file://{tmp_path}/b")
    assert warc.read_archive(spark, f"file://{tmp_path}/b").count() == 0


def test_columns_of_the_plan_do_not_hide_those_of_the_documents(spark):
    names = ["size", "taken", "target", "pass", "words", "position", "source_size", "Passes", "mix_size"]
    documents = spark.createDataFrame(
        [(1, "a b c", "s", *names), (2, "d", "t", *names)],
        "doc_id bigint, text string, source string, " + ", ".join(f"`{name}` string" for name in names),
    )
    for made in (mixing.curriculum(documents), mixing.training_order(documents)):
        rows = made.collect()
        assert made.columns[: len(documents.columns)] == documents.columns
        assert rows and all(row[name] == name for row in rows for name in names)
        assert {row["mix_mix_size"] for row in rows} == {1, 3} and all(row["mix_position"] >= 0 for row in rows)


@pytest.mark.parametrize("unit", ["again", "one two", "a b c d e f g"])
def test_repeated_words_cost_no_more_than_their_postings(spark, unit):
    count = len(unit.split())
    documents = spark.createDataFrame([(1, " ".join([unit] * (20_000 // count))), (2, "something else")], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, " ".join([unit] * (2_000 // count))), (2, " ".join([unit] * (40 // count)) + " end"),
                                   (3, "only other words")], BENCHMARK)
    rows = {r.doc_id: r for r in decontamination.contamination(documents, items).select("row.doc_id", "n_words", "n_hit", "item_ids").collect()}
    assert rows[1].n_hit == rows[1].n_words == 20_000 // count * count and rows[1].item_ids == ["1", "2"] and rows[2].n_hit == 0


def test_windows_of_an_item_count_one_by_one(spark):
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(words[10:23] + ["x"] + words[30:]), " ".join(words[:12]), " ".join(["y"] + words + words[:13]), "again " * 30]
    documents = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    items = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[5:30])), (3, "again again again")], BENCHMARK)
    rows = {r.doc_id: (r.n_hit, r.item_ids) for r in decontamination.contamination(documents, items).select("row.doc_id", "n_hit", "item_ids").collect()}
    assert rows == {0: (13, ["1", "2"]), 1: (0, []), 2: (53, ["1", "2"]), 3: (30, ["3"])}
