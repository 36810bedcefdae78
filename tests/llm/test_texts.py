"""Packing, personal data, language model, sharding, quality and licences against brute force and round trips."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnstone.llm import language_model, licenses, packing, quality, sanitise
from turnstone.llm.common import bucket
from turnstone.llm.queries import tokenizer_path
from turnstone.llm.resharding import capacities, min_cost_flow, reshard, rewrite, transfers

SF = "/root/testdata/sf0.001"
LOW = {k: k + 32 for k in range(65, 91)}


# packing


def test_encoder_is_the_tokenizer():
    encoder = packing.Encoder(tokenizer_path())
    draw = random.Random(2)
    kinds = [chr(k) for k in range(0x20, 0x180)] + list("\t\n\r\x0b\x1c\x85\xa0‘’…—日本語é🙂़") + [" ", "  ", "\n\n", "'s", "'re", "<|endoftext|>"]
    texts = ["".join(draw.choice(kinds) for _ in range(draw.randint(0, 60))) for _ in range(1500)]
    for text in texts:
        ids = encoder.tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encoder.encode(text), dtype="<u4").tolist() == ids


def test_differencing_against_all_splits():
    draw = random.Random(8)
    for _ in range(40):
        sizes = [draw.randint(1, 60) for _ in range(draw.randint(1, 7))]
        ways = draw.randint(1, 3)
        groups = packing.differencing(sizes, ways)
        assert sorted(k for g in groups for k in g) == list(range(len(sizes))) and len(groups) <= ways
        top = max(sum(sizes[k] for k in g) for g in groups)
        best = min(max(sum(s for s, w in zip(sizes, ws, strict=True) if w == k) for k in range(ways)) for ws in product(range(ways), repeat=len(sizes)))
        assert top <= 4 / 3 * best + 1
    many = [draw.randint(1, 500) for _ in range(600)]
    sums = [sum(many[k] for k in g) for g in packing.windows(many, 2048)]
    assert max(sums) <= 2048 and max(sums) - min(sums) < 40
    assert packing.windows([], 2048) == [] and len(packing.windows([2048, 2048, 1], 2048)) == 3


def test_packing_round_trip(spark, edge_docs, edge_texts, no_docs):
    encoder = packing.Encoder(tokenizer_path())
    rows = packing.pack(edge_docs, tokenizer_path(), capacity=256, block=4).collect()
    by_window, total = defaultdict(list), Counter()
    for r in rows:
        ids = np.frombuffer(bytes(r.ids), dtype="<u4")
        assert len(ids) == r.length <= 256 and zlib.crc32(bytes(r.ids)) == r.ids_crc32
        by_window[r.sequence_id].append(r)
        total[r.doc_id] += r.length
    for pieces in by_window.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 256
    want = Counter()
    for doc, text in edge_texts:
        want[doc] += len(encoder.encode(text)) // 4 + 1
    assert total == want
    own = sorted((r.start, bytes(r.ids)) for r in rows if r.doc_id == 11)
    text = next(t for d, t in edge_texts if d == 11)
    assert b"".join(x for _, x in own) == encoder.encode(text) + np.array([1], "<u4").tobytes()
    assert sum(want.values()) / (256 * len(by_window)) > 0.93
    assert packing.pack(no_docs, tokenizer_path()).count() == 0


# personal data

RX = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
      "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(d if k % 2 == 0 else 2 * d - 9 * (d > 4) for k, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def holds(kind, found):
    digits = re.sub("[^0-9]", "", found)
    return {"ip": lambda: all(int(p) <= 255 for p in found.split(".")), "card": lambda: 12 <= len(digits) <= 19 and luhn(digits),
            "phone": lambda: 9 <= len(digits) <= 15, "email": lambda: True}[kind]()


def brute_spans(text):
    found = [(m.start(), k, m.end()) for k, kind in enumerate(RX) for m in re.finditer(RX[kind], text or "") if holds(kind, m.group())]
    return sorted(found)


def test_base_spans(spark, edge_docs, no_docs):
    draw = random.Random(6)
    parts = ["a@b.co", "x.y+z@q-r.example.org", ".", "-", "@", "1.2.3.4", "300.1.1.1", "0000255.1.2.3", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 010-9999",
             "+12", " ", "é", "🙂", "7", "12.", "+", "1 2", "\n", "_", "com"]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randint(0, 14))) for _ in range(400)]
    texts += ["1" * 50_000, "a" * 30_000, "9 " * 20_000 + "x", "a@b" * 5_000, None, ""]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in sanitise.digest(sanitise.find_personal_data(frame)).collect()}
    for k, text in enumerate(texts):
        spans = brute_spans(text)
        plain = ",".join(f"{list(RX)[i]}:{a}:{b}" for a, i, b in spans)
        r = got[k]
        assert r.base_sha256 == hashlib.sha256(plain.encode()).hexdigest(), (text, r)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(i == j for _, i, _ in spans) for j in range(4)]
    assert sanitise.digest(sanitise.find_personal_data(edge_docs)).count() == edge_docs.count()
    assert sanitise.sanitise(edge_docs).columns == edge_docs.columns
    assert sanitise.find_personal_data(no_docs).count() == 0


def test_disclosing_terms(spark):
    rows = [(k, f"line {k} zanzibar writes to bob@x.org here\nother words number {k}") for k in range(6)]
    rows += [(10 + k, f"plain text about common things and line {k}\nwrites here often, number {k}") for k in range(300)]
    rows += [(400, "ZANZIBAR again, alone"), (None, "a zanzibar too"), (None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r for r in sanitise.digest(sanitise.find_personal_data(frame, bits=5.0)).collect()}
    assert found[400].spans == "term:0:8" and found[10].spans == "" and found[400].n_email == 0
    assert found[0].spans == "term:7:15,email:26:35"
    clean = {r.doc_id: r.text for r in sanitise.sanitise(frame, bits=5.0).collect()}
    assert clean[0].split("\n")[0].startswith("line 0 [TERM] writes to [EMAIL] here".replace("[TERM]", "")) or "[TERM]" in clean[0]
    assert "bob@x.org" not in clean[0] and "anzibar" not in clean[400].lower() and clean[11] == dict(rows[6:9]).get(11, clean[11])
    # copies of one line are no evidence
    copies = spark.createDataFrame([(k, "quagga met bob@x.org") for k in range(9)] + [(50 + k, f"text {k} of other kind") for k in range(300)], "doc_id long, text string")
    assert all("term" not in r.spans for r in sanitise.digest(sanitise.find_personal_data(copies, bits=2.0)).collect())


def test_sanitise_is_native(spark, edge_docs):
    plan = sanitise.digest(sanitise.find_personal_data(edge_docs))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# language model


def test_language_model(spark, edge_docs, no_docs):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    fold = bucket(F.col("doc_id"), 7)
    for frame in (docs, edge_docs):
        rows = [(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()]
        got = language_model.score(frame, fold == 2, [fold.isin(0, 1, 3), fold.isin(4, 5, 6)]).collect()
        split = lambda t: [w for w in re.split(r"[\x20\x09-\x0D]+", (t or "").translate(LOW)) if w] + [None]
        held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2
        counts = Counter(w for d, t in rows if not held(d) for w in split(t))
        total, distinct = sum(counts.values()), len(counts)
        want = Counter()
        for d, t in rows:
            base = sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in split(t))
            want[(d, held(d), len(split(t)), sum(counts[w] > 0 for w in split(t)), total, round(base, 5))] += 1
        assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == want
        assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert language_model.score(no_docs, fold == 2, [fold == 1]).count() == 0


def test_model_is_normalised_and_learns():
    draw = np.random.default_rng(1)
    chance = np.array([0.1, 0.1] + [0.1] * 8)
    word = np.zeros(20_000, dtype=np.int64)
    for k in range(2, len(word)):  # each class is mostly followed by the next
        word[k] = (word[k - 1] + 1) % 10 if draw.random() < 0.8 else draw.integers(10)
    trainer = language_model.Trainer(language_model.start(chance), chance, 3)
    for _ in range(6):
        for k in range(2, len(word) - 256, 256):
            trainer.step(word[k - 2 : k + 254], word[k - 1 : k + 255], word[k : k + 256])
    r, q, c1, c2, b = trainer.params
    scores = (r @ c1)[word[1:-1]] + (r @ c2)[word[:-2]]
    logits = scores @ q.T + b
    p = np.exp(logits - logits.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    assert -np.log(p[np.arange(len(p)), word[2:]]).mean() < 1.6 < np.log(10)


def test_probabilities_of_all_words_sum_to_one(spark):
    rows = [(k, "a b c a b d " * 3 + f"w{k % 5}") for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    vocabulary = sorted({w for _, t in rows for w in t.split()})
    probe = spark.createDataFrame([(100 + k, w) for k, w in enumerate([*vocabulary, "never"])] + [(99, "")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in language_model.score(docs.union(probe), F.col("doc_id") >= 99, [F.col("doc_id") < 99], vocabulary=5).collect()}
    # P(word, end) over P(end | word): compare sums over first words by the chain of one-word texts
    assert all(math.isfinite(s) for s in got.values())
    assert sum(10**got[100 + k] for k in range(len(vocabulary) + 1)) + 10 ** got[99] <= 1 + 1e-9


# sharding


def test_flow_is_cheapest():
    from itertools import permutations

    draw = random.Random(4)
    for _ in range(60):
        n = draw.randint(1, 5)
        cost = [[draw.randint(0, 9) for _ in range(n)] for _ in range(n)]
        flow = min_cost_flow([1] * n, [1] * n, cost)
        assert sum(flow[i][j] * cost[i][j] for i in range(n) for j in range(n)) == min(sum(cost[i][p[i]] for i in range(n)) for p in permutations(range(n)))
        supply = [draw.randint(0, 50) for _ in range(n)]
        demand = capacities(sum(supply), n + 1)
        moved = min_cost_flow(supply, demand)
        assert [sum(r) for r in moved] == supply and [sum(c) for c in zip(*moved, strict=True)] == demand
        stay = sum(min(s, d) for s, d in zip(supply, demand, strict=False))
        assert sum(moved[i][i] for i in range(n)) == stay
    assert transfers([[3, 2], [0, 4]]) == [(0, 0, 0, 3), (0, 1, 3, 5), (1, 1, 0, 4)]


def test_reshard(spark, edge_docs, no_docs, tmp_path):
    docs = spark.createDataFrame([(k % 90, "x" * (k % 37), k % 3) for k in range(500)] + [(None, None, 0)], "doc_id long, text string, old int")
    rows = reshard(docs, F.col("old"), 3, 5).collect()
    assert len(rows) == 501 and sum(r.size for r in rows) == sum(k % 37 + 1 for k in range(500)) + 1
    by_shard = defaultdict(list)
    for r in rows:
        by_shard[r.shard].append(r)
    sizes = {k: sum(r.size for r in v) for k, v in by_shard.items()}
    assert max(sizes.values()) - min(sizes.values()) <= 4 * 37
    assert all(sorted(r.slot for r in v) == list(range(len(v))) for v in by_shard.values())
    assert all(r.text_crc32 == zlib.crc32(b"") for r in rows if r.size == 1)
    assert reshard(edge_docs, F.lit(0), 1, 2).count() == edge_docs.count() and reshard(no_docs, F.lit(0), 1, 2).count() == 0
    path = str(tmp_path / "shards")
    rewrite(docs.withColumnRenamed("old", "shard"), path, [0, 1, 2])
    rewrite(docs.select("doc_id", F.lit("new").alias("text"), F.col("old").alias("shard")), path, [1])
    back = spark.read.parquet(path)
    assert back.count() == 501 and back.where("text = 'new'").select("shard").distinct().collect()[0].shard == 1


def test_rewrite_empties_a_shard_that_lost_all_rows(spark, tmp_path):
    path = str(tmp_path / "shards")
    rewrite(spark.createDataFrame([(1, "a", 0), (2, "b", 1), (3, "c", 2)], "doc_id long, text string, shard int"), path, [0, 1, 2])
    rewrite(spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "doc_id long, text string, shard int"), path, [0, 1])
    back = [(r.doc_id, r.text, r.shard) for r in spark.read.parquet(path).collect()]
    assert sorted(back) == [(1, "a", 0), (2, "b", 0), (3, "c", 2)]


def test_reshard_of_rows_without_an_old_shard(spark, tmp_path):
    given = [(k, "x" * (k % 37), (0, 1, 2, None, 7, -1)[k % 6]) for k in range(300)]
    docs = spark.createDataFrame(given, "doc_id long, text string, old int")
    moved = reshard(docs, F.col("old"), 3, 5, carried=("text", "old"))
    rows = moved.collect()
    assert {(r.doc_id, r.text, r.old_shard) for r in rows} == set(given) and len(rows) == 300
    sizes = Counter()
    for r in rows:
        sizes[r.shard] += r.size
    assert max(sizes.values()) - min(sizes.values()) <= 4 * 37
    path = str(tmp_path / "shards")
    rewrite(moved, path, [0, 1, 2, 3, 4])
    assert {(r.doc_id, r.text, r.shard) for r in spark.read.parquet(path).collect()} == {(r.doc_id, r.text, r.shard) for r in rows}


# quality


def test_quality(spark, edge_docs, no_docs):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    vectors = quality.with_features(docs.select("doc_id", "text"))
    model = quality.fit(vectors.where(bucket(F.col("doc_id"), 4) != 2), labels)
    scored = docs.join(labels, "doc_id").where(bucket(F.col("doc_id"), 4) == 2).select("quality", quality.score_column(model, "text", True).alias("s")).collect()
    assert sum((r.s >= 0.7) == (r.quality == 1) for r in scored) / len(scored) > 0.97
    x = np.array([quality.features(t) for t in ("", None, "a b", "é" * 9, "word " * 30_000)])
    assert np.isfinite(x).all() and (x[0] == x[1]).all()
    logs = []
    for k in (0, 1):  # the cached factors give the Gaussian log densities
        precision = model.inverses[k].T @ model.inverses[k]
        d = x - model.means[k]
        logs.append(model.constants[k] - 0.5 * np.einsum("ni,ij,nj->n", d, precision, d))
    assert np.allclose(model.scores(x), 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700))))
    scores = [r.s for r in edge_docs.select(quality.score_column(model, "text", True).alias("s")).collect()]
    assert len(scores) == edge_docs.count() and all(0 <= s <= 1 for s in scores)
    odd = spark.createDataFrame([(1, None), (None, 1), (3, 7), (4, 1)], "doc_id long, quality int")
    alone = quality.fit(quality.with_features(edge_docs), odd)
    assert not alone.separates and alone.scores(x)[0] == pytest.approx(2 / 3)
    assert quality.with_features(no_docs).count() == 0 and not quality.fit(quality.with_features(no_docs), odd).separates


# licences


def test_automaton_against_all_substrings():
    draw = random.Random(0)
    for _ in range(30):
        texts = [[draw.choice([b"a", b"b", b"c"]) for _ in range(draw.randint(0, 12))] for _ in range(4)]
        auto = licenses.Automaton(texts)
        parts = {tuple(s[i:j]) for s in texts for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
        for _ in range(20):
            d = [draw.choice([b"a", b"b", b"c", b"x"]) for _ in range(15)]
            longest = [max(n for n in range(k + 2) if n == 0 or tuple(d[k + 1 - n : k + 1]) in parts) for k in range(len(d))]
            want = [(k, longest[k]) for k in range(len(d)) if longest[k] >= 2 and (k + 1 == len(d) or longest[k + 1] != longest[k] + 1)]
            runs = list(auto.runs(d, 2))
            assert [(e, n) for _, e, n in runs] == want
            for state, end, n in runs:
                piece = d[end - n + 1 : end + 1]
                firsts = {t: next(k + n - 1 for k in range(len(s)) if s[k : k + n] == piece) for t, s in enumerate(texts) if any(s[k : k + n] == piece for k in range(len(s)))}
                assert auto.ends[state] == firsts


def test_licences(spark, edge_docs, no_docs):
    mit = licenses.TEMPLATES[1][1]
    texts = ["Under the MIT licence; under the mit LICENSE! cc-by-nc cc by nc", "x " * 50 + mit.replace("free of charge", "at no cost at all") + " y", None, "", "under the mit",
             "Apache License, Version 2.0", "The license is free"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.digest(licenses.scan(frame)).collect()}
    assert (got[0].n_base, got[0].first_word, got[0].last_word, got[0].base_labels) == (3, 4, 11, "cc-by-nc,mit")
    assert got[1].labels == "mit" and got[1].n_base == 0 and got[1].base_labels == "" and 0.8 <= got[1].score <= 1
    span = next(s for r in licenses.scan(frame.where("doc_id = 1")).collect() for s in r.spans if s.share > 0.8)
    assert span.first == 50
    assert [(got[k].n_words, got[k].n_base, got[k].first_word, got[k].labels, got[k].score) for k in (2, 3)] == [(0, 0, None, "", 0.0)] * 2
    assert got[4].labels == "" and got[5].base_labels == "apache-2" and got[6].labels == ""
    assert licenses.scan(edge_docs).count() == edge_docs.count() and licenses.scan(no_docs).count() == 0


def test_encoder_of_very_long_runs():
    """Runs that would exhaust a stack are encoded by the other library; both agree where both can."""
    from turnstone.llm.queries import tokenizer_path

    encoder = packing.Encoder(tokenizer_path())
    for unit in (" ", "\t", "\n", " \n"):
        text = "start" + unit * (2_000_000 // len(unit)) + "end"
        assert len(encoder.encode(text)) > 4_000
        short = "start" + unit * (30_000 // len(unit)) + "end"
        want = encoder.tokenizer.encode(short, add_special_tokens=False).ids
        assert encoder.encode(short) == np.array(want, dtype="<u4").tobytes()
    assert len(encoder.encode("a" * 2_000_000)) > 4_000
    near = ("x" + " " * 999) * 2_000
    assert encoder.encode(near) == np.array(encoder.fast.encode_ordinary(near), dtype="<u4").tobytes()


def test_many_numbers_in_one_text(spark):
    """Places of many matches, and many short numbers, in time that grows with the text."""
    numbers = ", ".join(str(10 + k % 90) for k in range(100_000))
    addresses = " ".join(f"10.1.{k % 256}.{k // 256 % 256}" for k in range(20_000))
    docs = spark.createDataFrame([(1, numbers), (2, addresses), (3, "4111 1111 1111 1111 22, 4111-1111-1111-1111")], "doc_id long, text string")
    got = {r.doc_id: r.spans for r in sanitise.base_spans(docs).select("doc_id", "spans").collect()}
    assert got[1] == [] and [(s.start, s.end) for s in got[3]] == [(24, 43)]
    assert all(addresses[s.start : s.end] == s.found for s in got[2]) and len(got[2]) == 20_000
