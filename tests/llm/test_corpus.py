"""The corpus operators against brute force, round trips and held-out accuracy, and their edge cases."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import time
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.llm import chat, decontaminate, lang_id, mixing, ngram_join, quality_resampling, quality_rules, toxicity, url_rules, warc
from tidewell.llm.components import connected_components
from tidewell.llm.shared import best_cut, scratch

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint, label_x string"
WORD = re.compile("[^\x20\x09-\x0d]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


@pytest.fixture(scope="module")
def texts():
    """Near and exact copies, chains, common passages, odd bytes, blanks and nulls."""
    draw = random.Random(4)
    word = lambda: "".join(draw.choice("abcdeghé") for _ in range(draw.randint(2, 6)))
    passage = " ".join(word() for _ in range(40))
    out = [None, "", " \n\t", "one", "One", "two words", "a b c d", "a b c d e", "x\u00a0y z", "tab\tand\x0bvt", "🙂 emoji 🙂 again 🙂 three"]
    for _ in range(25):
        base = [word() for _ in range(draw.randint(5, 120))]
        out.append(" ".join(base))
        for _ in range(draw.randint(0, 5)):
            copy = list(base)
            for _ in range(draw.randint(0, 4)):
                copy[draw.randrange(len(copy))] = word()
            out.append(" ".join(copy).capitalize())
            base = copy if draw.random() < 0.5 else base
    out += [passage + " " + " ".join(word() for _ in range(draw.randint(3, 60))) for _ in range(25)]
    return out + out[11:14]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", "src", None, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


# --- n-gram join --------------------------------------------------------------------------------


def shingles(text):
    w = WORD.findall(lower(text or ""))
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute_components(ids, texts):
    sets = [shingles(t) for t in texts]
    root = list(range(len(sets)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]) or ids[i] == ids[j]:
                a, b = sorted((top(i), top(j)))
                root[b] = a
    least = {}
    for i in range(len(sets)):
        least[top(i)] = min(least.get(top(i), ids[i]), ids[i])
    return sorted((ids[i], len(sets[i]), least[top(i)]) for i in range(len(sets)))


def test_ngram_join_is_exact(docs, texts):
    got = sorted(tuple(r) for r in ngram_join.ngram_join(docs).select("doc_id", "n_shingles", "component_id").collect())
    assert got == brute_components(list(range(len(texts))), texts)


def test_ngram_join_when_everything_is_split(docs, texts, monkeypatch):
    """Tiny groups, blocks and broadcasts: the same result by the other ways."""
    for name, value in (("MOST_MEMBERS", 2), ("BLOCK_SETS", 2), ("MOST_BROADCAST", 0), ("MOST_FREQUENT", 4)):
        monkeypatch.setattr(ngram_join, name, value)
    got = sorted(tuple(r) for r in ngram_join.ngram_join(docs).collect())
    assert got == brute_components(list(range(len(texts))), texts)


def test_ngram_join_of_copies_around_a_missing_base(spark):
    """Copies that link to one another only through others, in many partitions, the base without a row of its own."""
    draw = random.Random(9)
    word = lambda: "".join(draw.choice("klmnop") for _ in range(5))
    base = [word() for _ in range(60)]
    out = []
    for _ in range(60):
        copy = list(base)
        for _ in range(draw.randint(1, 3)):
            copy[draw.randrange(60)] = word()
        out.append(" ".join(copy))
    got = sorted(tuple(r) for r in ngram_join.ngram_join(spark.createDataFrame(list(enumerate(out)), "doc_id bigint, text string").repartition(12)).collect())
    assert got == brute_components(list(range(60)), out)


def test_ngram_join_edges(spark, none):
    assert ngram_join.ngram_join(none).isEmpty()
    rows = [(5, "a b c d e f"), (5, "q r s t u v"), (3, "a b c d e f"), (9, "q r s t u v"), (None, "a b c d e f"), (7, None), (5, "a b c d e f")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("gid", F.lit(1)).withColumn("block", F.lit(1))
    got = sorted(((r["doc_id"] if r["doc_id"] is not None else -1, r["component_id"]) for r in ngram_join.ngram_join(frame).collect()), key=str)
    assert got == sorted([(5, 3), (5, 3), (5, 3), (3, 3), (9, 3), (-1, None), (7, 7)], key=str)
    kept = ngram_join.keep_one(frame)
    assert kept.columns == frame.columns
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 3, 7]


def test_one_row_of_a_repeated_id_stays_with_columns_of_any_type(spark):
    rows = [(1, "q r s t u v", {"x": 1}, None), (1, "a b c d e f", {"x": 1}, None), (1, "a b c d e f", {"w": 2}, [1]), (2, "a b c d e f", None, [2]), (4, None, {"y": 3}, None), (4, "k", None, None)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, row map<string,int>, n array<int>")
    assert sorted(tuple(r) for r in ngram_join.keep_one(frame).collect()) == [(1, "a b c d e f", {"w": 2}, [1]), (4, None, {"y": 3}, None)]


@pytest.mark.parametrize("texts", [[None, " \n"], [None, None, "a b c d e f"], ["", "a b c d e f g", "A b c d e f g"]])
def test_ngram_join_of_partitions_without_words(spark, texts):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").repartitionByRange(len(texts), "doc_id")
    assert sorted(tuple(r) for r in ngram_join.ngram_join(frame).collect()) == brute_components(list(range(len(texts))), texts)
    assert sorted(r["doc_id"] for r in ngram_join.keep_one(frame).collect()) == sorted({c for _, _, c in brute_components(list(range(len(texts))), texts)})


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 1), (3, 3), (9, 8), (8, 7), (7, 2), (20, 21)], "a bigint, b bigint")
    assert {r["node"]: r["component"] for r in connected_components(edges).collect()} == {1: 1, 2: 1, 7: 1, 8: 1, 9: 1, 20: 20, 21: 20}


# --- decontamination ----------------------------------------------------------------------------

TOKEN = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def brute_passages(texts, items):
    windows = {}
    for item, text in items:
        w = TOKEN.findall(lower(text)) if text and item is not None else []
        for i in range(max(len(w) - 9, 1) if w else 0):
            windows.setdefault(tuple(w[i : i + 10]), set()).add(item)
    out = []
    for text in texts:
        w, hit, found = TOKEN.findall(lower(text or "")), set(), set()
        for size in {len(x) for x in windows}:
            for i in range(len(w) - size + 1):
                if own := windows.get(tuple(w[i : i + size])):
                    hit |= set(range(i, i + size))
                    found |= own
        out.append((len(w), len(hit), sorted(found)))
    return out


@pytest.fixture(scope="module")
def contaminated():
    draw = random.Random(2)
    word = lambda: draw.choice(["ab", "cd", "ef", "gh", "ÏJ", "kl9", "m"])
    items = [(i, " ".join(word() for _ in range(draw.choice([3, 8, 12, 25])))) for i in range(8)] + [(20, None), (21, "?!"), (22, "ab cd"), (None, "ef gh"), (3, "kl9 kl9 kl9")]
    texts = [None, "", "ab", "AB, cd!"] + [" ".join(word() for _ in range(draw.randint(0, 400))) for _ in range(30)]
    texts += [f"{word()} {word()} {t.upper()}. {word()}" for _, t in items[:8]] + [items[5][1]] * 4 + ["ab " * 300]
    return texts, items


def test_passages_are_found(spark, contaminated, monkeypatch):
    texts, items = contaminated
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id bigint, text string, spans string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    want = brute_passages(texts, items)
    for block_words, shard in ((decontaminate.BLOCK_WORDS, decontaminate.SHARD_BYTES), (60, 500)):
        monkeypatch.setattr(decontaminate, "SHARD_BYTES", shard)
        blocks = decontaminate.phrase_blocks(bench, block_words=block_words)
        monkeypatch.setattr(decontaminate, "phrase_blocks", lambda *_, blocks=blocks: blocks)
        rows = {r["doc_id"]: (r["n_words"], r["n_hit"], r["item_ids"]) for r in decontaminate.find_passages(docs, bench).collect()}
        assert [rows[i] for i in range(len(texts))] == want
        monkeypatch.undo()


def test_fm_index_against_search():
    draw = np.random.default_rng(0)
    words = np.append(draw.integers(0, 4, 500), 0)
    index = decontaminate.FMIndex(words, 3)
    for size in (1, 2, 5):
        phrases = draw.integers(1, 4, (20, size))
        for i, p in enumerate(phrases):
            which, low, high = index.search(phrases[i : i + 1], np.array([size]))
            got = sorted(index.locate(np.arange(low[0], high[0]))) if len(which) else []
            assert got == [j for j in range(len(words) - size + 1) if (words[j : j + size] == p).all()]


def test_passages_are_cut_out(spark, none):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven")], "item_id bigint, text string")
    passage = "One two, three four five six seven eight nine ten eleven"
    rows = [(1, f"Start. {passage}! End", "en", "s", 99, "x"), (2, passage, "en", "s", 9, "x"), (3, None, None, None, None, None), (4, "clean text", "en", "s", 10, "x")]
    out = decontaminate.remove_passages(spark.createDataFrame(rows, DOC), bench)
    assert out.columns == [c.split()[0] for c in DOC.split(", ")]
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in out.collect()}
    assert got == {1: ("Start. ! End", 12), 3: (None, None), 4: ("clean text", 10)}
    named = spark.createDataFrame(rows, DOC).withColumns({"spans": F.lit("mine"), "N_HIT": F.lit(7), "n_hit_": F.lit(8)})
    out = decontaminate.remove_passages(named, bench)
    assert out.columns == named.columns and out.count() == 3 and out.where("spans <> 'mine' or N_HIT <> 7 or n_hit_ <> 8").isEmpty()
    assert decontaminate.remove_passages(none, bench).isEmpty()
    assert decontaminate.find_passages(none.unionByName(none), bench.where("item_id = 0")).isEmpty()


# --- chat ---------------------------------------------------------------------------------------


def test_chat_round_trip(spark):
    nasty = ["", "\\", "\\b", "###", "#### x", "</turn>", "</turn>\n### user:\n", "<turn/>", "\\h\\e\\n\\l", "a\nb", "🙂é", None, "##", "\\### Assistant: </turn> ok"]
    draw = random.Random(1)
    rows = [(c, t, draw.choice(["user", "assistant", "system", "a:\nb", None]), draw.choice(nasty)) for c in range(30) for t in range(draw.randint(1, 9))]
    rows += [(99, 0, "assistant", "x"), (99, 0, "assistant", "x"), (99, None, "assistant", "late"), (None, 0, "user", "q")]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("formatted", F.lit("clash"))
    out = chat.format_chat(frame)
    read = out.select("conv_id", "formatted", chat.read_chat(F.col("formatted")).alias("turns"), chat.masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    want = {}
    for c, t, role, text in sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((role or "", text or ""))
    got = {r["conv_id"]: r for r in read.collect()}
    assert {c: [tuple(x) for x in r["turns"]] for c, r in got.items()} == want
    assert all(r["loss"] == "".join(t for role, t in want[c] if role == "assistant") for c, r in got.items())
    assert got[99]["formatted"].count("### ") == 1
    assert chat.format_chat(frame.where("false")).isEmpty()


# --- warc ---------------------------------------------------------------------------------------


def test_bundles_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "FRAME_BYTES", 2000)
    rows = [(i, None if i == 3 else f"http://h/{i}?q=%20 é\r\n", None if i % 11 == 0 else f"<p>{i % 7}</p>é" * (i % 5)) for i in range(60)] + [(70, "u", "z" * 20000), (70, "u", "z" * 20000)]
    records = spark.createDataFrame(rows, "record_id bigint, url string, payload string").withColumn("n", F.lit(1)).repartition(3)
    index = warc.write_bundles(warc.payload_roles(records), scratch(spark, "warc"))
    first = {}
    for i, _, p in sorted(rows, key=lambda r: r[0]):
        first.setdefault(p or "", i)
    read = warc.read_bundles(index).collect()
    assert len(read) == len(rows)
    sent = {i: (u, p or "") for i, u, p in rows}
    for r in read:
        url, payload = sent[r["record_id"]]
        assert r["url"] == url and r["payload_bytes"] == len(payload.encode())
        import base64

        assert r["payload_digest"] == base64.b32encode(hashlib.sha1(payload.encode()).digest()).decode()
        lead = first[payload]
        assert (r["record_type"], r["refers_to"]) == (("response", None) if lead == r["record_id"] else ("revisit", lead))
        assert r["payload"] is None if r["record_type"] == "revisit" else bytes(r["payload"]).decode() == payload
    fetched = warc.fetch_records(index.where("record_id % 3 = 1").repartition(2)).collect()
    assert sorted(map(repr, fetched)) == sorted(repr(r) for r in read if r["record_id"] % 3 == 1)
    clash = records.withColumns({c: F.lit(5) for c in ("refers_to", "first_id", "r_id", "Payload_Digest", "n_")})
    roles = warc.payload_roles(clash)
    assert {"first_id", "r_id", "n_"} <= set(roles.columns) and roles.where("refers_to <=> 5").isEmpty() and roles.count() == len(rows)
    small = warc.payload_roles(records, least_bytes=10)
    assert small.where("octet_length(payload) < 10 and refers_to is not null").isEmpty()
    assert warc.read_bundles(warc.write_bundles(warc.payload_roles(records.where("false")), scratch(spark, "warc"))).isEmpty()


def test_bundles_are_read_by_many_tasks(spark):
    index = None
    for i in range(12):  # a bundle each
        record = spark.createDataFrame([(i, "u", str(i))], "record_id bigint, url string, payload string")
        own = warc.write_bundles(warc.payload_roles(record), scratch(spark, "warc"))
        index = own if index is None else index.unionByName(own)
    read = warc.read_bundles(index).withColumn("task", F.spark_partition_id()).collect()
    assert sorted(r["record_id"] for r in read) == list(range(12))
    assert len({r["task"] for r in read}) > 3


# --- mixing -------------------------------------------------------------------------------------


def exact_targets(sizes, weights=(5, 2, 1), share=Fraction(3, 2), most=2):
    """Water-filling in fractions: whoever would get more than its most is filled up, one at a time, fullest first."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    got, budget = {}, share * sum(sizes.values())
    for s in sorted(names, key=lambda s: Fraction(most * sizes[s], weight[s])):
        unit = budget / sum(w for x, w in weight.items() if x not in got)
        got[s] = min(weight[s] * unit, Fraction(most * sizes[s]))
        budget -= got[s]
    return got


@pytest.mark.parametrize(
    "sizes", [{"b": 100, "a": 100, None: 100, "c": 100}, {}, {"a": 0}, {"a": 0, "b": 7}, {"a": 10, "b": 1000, "c": 1000}, {chr(97 + i): (i * 7919) % 1000 for i in range(26)} | {None: 5000, "é": 30, "~": 1, "Z": 2}]
)
def test_targets(spark, sizes):
    totals = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, words bigint").repartition(3)
    got = {r["source"]: r["target"] for r in mixing.shared_targets(totals).collect()}
    want = exact_targets(sizes)
    assert got.keys() == want.keys() and all(got[s] == pytest.approx(float(want[s]), abs=1e-6) for s in got)


def test_flight_keeps_its_totals():
    draw = random.Random(0)
    sizes = [float(draw.choice([0, 3, 5, 50, 700, 20000])) for _ in range(500)]
    p = mixing.flight([0.3] * 500, sizes, draw)
    open_ = [i for i in range(500) if 0 < p[i] < 1]
    assert len(open_) <= 3
    assert sum(p) == pytest.approx(150) and sum(a * b for a, b in zip(p, sizes)) == pytest.approx(0.3 * sum(sizes))
    assert all(x in (0.0, 1.0) for x in mixing.landing(p, sizes, draw))


def test_flight_is_unbiased():
    sizes = [1.0, 2.0, 3.0, 10.0, 4.0, 4.0]
    runs = [mixing.landing(mixing.flight([0.4] * 6, sizes, d), sizes, d) for d in (random.Random(i) for i in range(4000))]
    assert np.allclose(np.mean(runs, axis=0), 0.4, atol=0.04)


def test_mix(spark, none, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 40)
    draw = random.Random(3)
    rows = [(i, "w " * draw.randint(0, 60), "en", f"s{i % 3}" if i % 10 else None, 0, "x") for i in range(600)] + [(600, None, "en", "s0", 0, "x"), (5, "w w", "en", "s2", 0, "x"), (5, "w w", "en", "s2", 0, "x"), (None, "w", "en", "s1", 0, "x")]
    frame = spark.createDataFrame(rows, DOC).withColumn("size", F.lit("clash")).repartition(7)
    out = mixing.mix_sources(frame.withColumns({c: F.lit("mine") for c in ("u_id", "u_source", "u_size", "mark", "words")})).persist()
    assert out.count() == len(rows) and out.where("u_id <> 'mine' or mark <> 'mine'").isEmpty()
    want = {}
    for _, text, _, source, *_ in rows:
        want[source] = want.get(source, 0) + len(WORD.findall(text or ""))
    targets = exact_targets(want)
    per = out.groupBy("source").agg(F.min("target").alias("target"), F.max("target").alias("t1"), F.max("source_size").alias("n"), F.sum("taken").alias("taken"))
    for r in per.collect():
        assert r["n"] == want[r["source"]] and r["target"] == r["t1"] == pytest.approx(float(targets[r["source"]]))
        assert r["target"] <= 2 * r["n"] and abs(r["taken"] - r["target"]) <= 60
    sizes = {(r["doc_id"], r["size"]) for r in out.collect()}
    assert sizes == {(i, len(WORD.findall(t or ""))) for i, t, *_ in rows}
    assert out.where("taken > 2 * size or taken <> size * times").isEmpty()
    monkeypatch.setattr(mixing, "MOST_BROADCAST", 0)
    again = mixing.mix_sources(frame.repartition(2))
    assert out.select("doc_id", "taken").exceptAll(again.select("doc_id", "taken")).isEmpty()
    assert mixing.mix_sources(none).isEmpty()


# --- classifiers --------------------------------------------------------------------------------


def test_best_cut():
    assert 0.4 < best_cut([0.1, 0.4, 0.8, 0.9], [False, False, True, True]) < 0.8
    assert best_cut([1.0], [True]) is None


def naive_buckets(text):
    """n-gram buckets of a text, one byte at a time."""
    raw = text.encode()
    letters = [b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in raw]
    out = []
    for order in lang_id.ORDERS:
        for i in range(len(letters) - order + 1):
            gram = letters[i : i + order]
            if gram[0] == 32 and gram[1] == 32:
                continue
            h = order * 0x9E3779B1 & 0xFFFFFFFF
            for b in gram:
                h = (h ^ b) * 0x01000193 & 0xFFFFFFFF
            h ^= h >> 15
            h = h * 0x85EBCA6B & 0xFFFFFFFF
            out.append((h ^ h >> 13) % lang_id.BUCKETS)
    return out


def test_language_decoding_against_a_plain_loop(spark):
    draw = random.Random(15)
    languages = ["aa", "bb", "cc", "dd", "ee", "ff"]
    text = lambda i: " ".join("".join(draw.choice("abcdefghijkl"[i : i + 6] + "é") for _ in range(draw.randint(1, 8))) for _ in range(draw.randint(1, 30)))
    rows = [(n, text(n % 6), languages[n % 6]) for n in range(240)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(3)
    model = lang_id.fit_codes(frame)
    counts = np.zeros((6, lang_id.BUCKETS))
    for _, t, lang in rows:
        for bucket in naive_buckets(t):
            counts[languages.index(lang), bucket] += 1
    share = (counts + 0.5) / (counts + 0.5).sum(axis=1, keepdims=True)
    for bit in range(model.code.shape[1]):
        on, off = share[model.code[:, bit] > 0].mean(axis=0), share[model.code[:, bit] < 0].mean(axis=0)
        assert np.allclose(model.weights[:, bit], np.log(on / off))
    got = {r["doc_id"]: r for r in lang_id.predict_language(frame, model).collect()}
    for n, t, _ in rows:
        found = naive_buckets(t)
        if not found:
            continue
        losses = []
        for code in model.code:
            loss = 0.0
            for bit in range(len(code)):
                margin = sum(model.weights[b, bit] for b in found) / len(found)
                scaled = min(max((margin - model.middle[bit]) / model.spread[bit], -4), 4)
                loss += model.spread[bit] / model.spread.sum() * np.log1p(np.exp(-2.0 * scaled * float(code[bit])))
            losses.append(loss)
        chance = np.exp(-4 * (np.array(losses) - min(losses)))
        chance /= chance.sum()
        assert got[n]["score"] == pytest.approx(chance.max()) and got[n]["lang_pred"] == languages[int(np.argmin(losses))]
        assert got[n]["ambiguous"] == (sorted(chance)[-2] > 0.5 * chance.max())


def test_every_language_is_learned(spark, monkeypatch):
    """More languages than a task holds or the driver compares; the rarest has one row."""
    draw = random.Random(21)
    stems = {f"l{i:04d}": ["".join(draw.choice("abcdefghijklmnopqrstuvwxyzäöéñ") for _ in range(3)) for _ in range(6)] for i in range(700)}
    text = lambda lang: " ".join("".join(draw.choices(stems[lang], k=2)) for _ in range(60))
    rows = [(i, text(lang), lang) for i, lang in enumerate([*stems, *list(stems)[1:], "l0001"])]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumn("lettered", F.lit(3)).repartition(2)
    for compared in (lang_id.COMPARED, 10):
        monkeypatch.setattr(lang_id, "COMPARED", compared)
        model = lang_id.fit_codes(frame)
        assert model.languages == tuple(stems) and len({tuple(c) for c in model.code}) == 700 and model.languages[model.usual] == "l0001"
    out = lang_id.predict_language(frame, model)
    assert out.columns == [*frame.columns, "lang_pred", "score", "ambiguous"]
    assert out.where("lang_pred = lang").count() >= 0.95 * len(rows)


def test_codewords_are_apart():
    for k in (2, 3, 4, 5, 9, 40):
        code = lang_id.codewords(k).astype(int)
        assert len({tuple(c) for c in code}) == k
        assert min((a != b).sum() for i, a in enumerate(code) for b in code[:i]) >= (1 if k < 3 else 2)


def test_language_held_out(spark, none):
    stems = {"aa": "the and of with er ing", "bb": "der die und ung sch ein", "cc": "que los des ción ar el"}
    draw = random.Random(5)
    rows = [(i, " ".join(draw.choice(stems[k].split()) for _ in range(draw.randint(3, 40))), k, "s", 0, "x") for i, k in enumerate(sorted(stems) * 60)]
    frame = spark.createDataFrame(rows, DOC)
    model = lang_id.fit_codes(frame.where("doc_id % 4 > 0"))
    got = lang_id.predict_language(frame.where("doc_id % 4 = 0").withColumn("score", F.lit("clash")), model)
    assert got.where("lang_pred <> lang").count() <= 1 and got.where("score < 0 or score > 1").isEmpty()
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !?"), (4, "a"), (5, "дом")], "doc_id bigint, text string")
    assert [r["lang_pred"] == "und" for r in lang_id.predict_language(odd, model).orderBy("doc_id").collect()] == [True, True, True, False, False]
    assert lang_id.fit_codes(none) is None
    assert lang_id.predict_language(odd, None).where("lang_pred <> 'und'").isEmpty()
    one = lang_id.fit_codes(frame.where("lang = 'aa'"))
    assert lang_id.predict_language(odd, one).where("lang_pred not in ('aa', 'und')").isEmpty()
    assert lang_id.predict_language(none, model).isEmpty()


def test_ordinal_fit_recovers_order():
    draw = np.random.default_rng(1)
    x = draw.random((600, 5)) < 0.3
    grade = np.clip((x[:, 0] * 2 + x[:, 1] + (draw.random(600) < 0.1)).astype(int), 0, 3)
    row, column = np.nonzero(x)
    w, theta = toxicity._fit(row, column, grade, 5)
    assert w[0] > w[1] > max(abs(w[2:])) and (np.diff(theta) > 0).all()


def test_ordinal_fit_against_a_dense_reference():
    """The fitted parameters are at the minimum of the penalised likelihood, written out densely."""
    draw = np.random.default_rng(4)
    x = (draw.random((400, 4)) < 0.4).astype(float)
    grade = np.clip((x[:, 0] * 2 + x[:, 1] + draw.logistic(size=400) > 1).astype(int) + (x[:, 0] + draw.logistic(size=400) > 2), 0, 2)
    times = draw.integers(1, 4, 400)
    row, column = np.nonzero(x)
    w, theta = toxicity._fit(row, column, grade, 4, times, rounds=4000, decay=1e-2)

    def loss(w, theta):
        above = np.concatenate((np.ones((400, 1)), 1 / (1 + np.exp(-((x @ w)[:, None] - theta[None, :]))), np.zeros((400, 1))), axis=1)
        p = above[np.arange(400), grade] - above[np.arange(400), grade + 1]
        return -(times * np.log(p)).sum() / times.sum() + 0.5e-2 * w @ w

    least = loss(w, theta)
    for i in range(4):
        for step in (-0.02, 0.02):
            assert loss(w + step * np.eye(4)[i], theta) > least
    for i in range(2):
        for step in (-0.02, 0.02):
            assert loss(w, theta + step * np.eye(2)[i]) > least


def test_near_copies_are_one_piece_of_evidence(spark):
    """Hundreds of near copies of one toxic text count as a few rows: most of its words are no sign of toxicity."""
    draw = random.Random(11)
    vocabulary = ["".join(draw.choice("abdefgho") for _ in range(6)) for _ in range(300)]
    base = [draw.choice(vocabulary) for _ in range(200)]
    rows, labels = [], []
    for i in range(600):
        bad = i % 6 == 0
        words = [draw.choice(vocabulary) for _ in range(draw.randint(5, 80))]
        if bad:
            words[draw.randrange(len(words))] = "scumx"
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    for i in range(600, 900):
        words = list(base)
        words[draw.randrange(200)] = draw.choice(vocabulary)
        rows.append((i, " ".join([*words, "scumx"])))
        labels.append((i, 1))
    docs, known = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    model = toxicity.fit_severity(docs, known)
    assert len(model.features) < 40  # of about 150 words of the copied text
    got = {r["doc_id"]: r["rejected"] for r in toxicity.score_severity(docs, model).collect()}
    assert got[700] and all(got[i] == (i % 6 == 0) for i in range(600))


def test_toxicity_held_out(spark, none):
    draw = random.Random(6)
    vocabulary = ["".join(draw.choice("abdefgho") for _ in range(6)) for _ in range(300)]
    clean = lambda n: [draw.choice(vocabulary) for _ in range(n)]
    rows, labels = [], []
    for i in range(600):
        bad = i % 6 == 0
        words = clean(draw.randint(5, 80))
        for _ in range(draw.randint(1, 6) if bad else 0):
            words[draw.randrange(len(words))] = draw.choice(["Scumx", "vilest", "vilely"])
        rows.append((i, " ".join(words) + ".", "en", "s", 0, "x"))
        if i % 3:
            continue
        labels.append((i, int(bad)))
    rows += [(1000, None, None, None, None, None), (1001, "", "en", "s", 0, "x")]
    frame, known = spark.createDataFrame(rows, DOC), spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id bigint, toxic int")
    model = toxicity.fit_severity(frame, known)
    got = {r["doc_id"]: r for r in toxicity.score_severity(frame.withColumn("severity", F.lit("clash")), model).collect()}
    wrong = [(i, round(got[i]["severity"], 3), rows[i][1][:60]) for i in range(600) if got[i]["rejected"] != (i % 6 == 0)]
    assert not wrong, (model.cut, wrong[:5])
    assert not got[1000]["rejected"] and not got[1001]["rejected"]
    assert toxicity.drop_toxic(frame, known).count() == 502 and toxicity.drop_toxic(frame, known).columns == frame.columns
    assert toxicity.drop_toxic(frame, known.where("toxic = 0")).count() == 602
    named = frame.withColumns({"rejected": F.lit("mine"), "Severity": F.lit(1)})
    kept = toxicity.drop_toxic(named, known)
    assert kept.columns == named.columns and kept.where("rejected <> 'mine'").isEmpty() and kept.count() == 502
    assert toxicity.drop_toxic(none, known).isEmpty()


def test_resampling(spark, none):
    draw = random.Random(7)
    good = lambda: " ".join(draw.choice("the river runs past an old stone mill and it turns".split()) for _ in range(draw.randint(5, 60)))
    bad = lambda: " ".join(draw.choice("win!!! ### $$$ click ||| free".split()) for _ in range(draw.randint(5, 60)))
    rows = [(i, bad() if i % 5 == 0 else good(), "en", "s", 0, "x") for i in range(500)] + [(900, None, None, None, None, None), (901, " ", "en", "s", 0, "x")]
    frame, labels = spark.createDataFrame(rows, DOC), spark.createDataFrame([(i, int(i % 5 > 0)) for i in range(200)], "doc_id bigint, quality int")
    kept = {r["doc_id"]: r["kept"] for r in quality_resampling.resample_quality(frame, labels).collect()}
    wrong = [(i, rows[i][1]) for i in range(500) if kept[i] != (i % 5 > 0)]
    assert not wrong, wrong[:4]
    assert not kept[900] and not kept[901]
    model, held = quality_resampling.fit_ratio(frame, labels)
    used = {i for i in range(200) if i % 5 > 0 and i not in held}
    raw, target, own = np.zeros(quality_resampling.BUCKETS), np.zeros(quality_resampling.BUCKETS), {}
    for i, text, *_ in rows:
        _, bucket = quality_resampling._grams(np.frombuffer((text or "").encode(), np.uint8), np.array([0, len((text or "").encode())]))
        own[i] = bucket
        np.add.at(raw, bucket, 1)
        if i in used:
            np.add.at(target, bucket, 1)
    share = raw / raw.sum()
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = np.where(raw > 0, np.log((target + quality_resampling.PRIOR * share) / (target.sum() + quality_resampling.PRIOR) / share), 0)
    assert np.allclose(model.ratio / 65536, ratio, atol=1e-5)
    table = quality_resampling.resample_quality(frame, labels).collect()
    for r in table:
        if r["log_weight"] is not None:
            assert r["log_weight"] == pytest.approx(ratio[own[r["doc_id"]]].sum(), abs=1e-5 * len(own[r["doc_id"]]))
    keys = sorted((r["key"] for r in table if r["key"] is not None), reverse=True)
    assert [r["kept"] for r in table] == [r["key"] is not None and r["key"] >= keys[399] for r in table]  # 400 are expected to be good
    some = quality_resampling.resample_quality(frame, labels, k=37)
    assert {r["doc_id"] for r in some.where("kept").collect()} == {r["doc_id"] for r in table if r["key"] is not None and r["key"] >= keys[36]}
    assert some.where("kept").count() == 37
    out = quality_resampling.drop_poor(frame, labels)
    assert out.columns == frame.columns and out.count() == 400
    assert quality_resampling.drop_poor(frame, labels.where("false")).count() == 500
    named = quality_resampling.drop_poor(frame.withColumn("Log_Weight", F.lit("mine")), labels)
    assert named.count() == 400 and named.where("Log_Weight <> 'mine'").isEmpty()
    assert quality_resampling.drop_poor(none, labels).isEmpty()


def test_kth_largest(spark):
    values = [float(x) for x in range(1000)] + [5.0] * 50 + [None]
    frame = spark.createDataFrame([(v,) for v in values], "key double")
    want = sorted((v for v in values if v is not None), reverse=True)
    for k in (1, 7, 500, 1040, 1050):
        assert quality_resampling.kth_largest(frame, k, few=20) == want[k - 1]
    assert quality_resampling.kth_largest(frame, 1051) is None and quality_resampling.kth_largest(frame, 0) is None


# --- rules --------------------------------------------------------------------------------------


def brute_rules(text):
    text = text or ""
    w = WORD.findall(text)
    at = {}
    for i in range(len(w) - 2):
        at.setdefault(tuple(w[i : i + 3]), []).append(i)
    repeat = {j for places in at.values() if len(places) > 1 for i in places for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeat)


def test_quality_counts(spark, docs, texts, none):
    extra = ["a b c a b c", "x x x x", "l one\nl one\n\n \nl one", "a b", "#$ *|\n<>", "p q r s p q r t q r s", "y " * 500]
    frame = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(extra)], "doc_id bigint, text string")).withColumn("kept", F.lit("clash"))
    rows = {r["doc_id"]: r for r in quality_rules.apply_rules(frame).collect()}
    for i, text in [*enumerate(texts), *((1000 + i, t) for i, t in enumerate(extra))]:
        r = rows[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute_rules(text), text
        assert r["base_failed"] == (r["n_words"] < 50 or 2 * r["n_repeat_words"] > r["n_words"]) and not (r["base_failed"] and r["kept"])
    assert quality_rules.apply_rules(none).isEmpty()


def test_native_plans(spark, capsys):
    pages = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    quality_rules.apply_rules(pages).explain("formatted")
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
    chat.format_chat(spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")).explain("formatted")
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Arrow" not in plan


RULES = [url_rules.HostRule(*x) for x in (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"))]


def test_url_parts_and_listed_rules(spark):
    cases = {
        "http://A.Example.COM/en/x?q#f": ("a.example.com", "/en/x", "example.com/en/", "block"),
        "https://www.example.com/en/": ("www.example.com", "/en/", "www.example.com/en/", "allow"),
        "https://badexample.com/en/": ("badexample.com", "/en/", "com/", "allow"),
        "https://example.com": ("example.com", "", None, None),
        "ftp://x.net/es/?a": ("x.net", "/es/", "net/es/", "block"),
        "http://h?x://y/z": ("h", "", None, None),
        "no scheme": ("", "", None, None),
        "http://": ("", "", None, None),
        "a://b\n.com/c://d/": ("b\n.com", "/c://d/", "com/", "allow"),
        None: ("", "", None, None),
    }
    frame = spark.createDataFrame([(i, u, "x") for i, u in enumerate(cases)], "page_id bigint, url string, rule string")
    rules = url_rules.mine_rules(frame.select("url", F.lit(False).alias("bad")))
    out = {r["url"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_rules.judge_urls(frame, RULES, rules).collect()}
    assert out == {u: (*want[:3], want[3] or "allow") for u, want in cases.items()}


def naive_rules(labelled, least_support, least_confidence):
    """tokens -> (support, confidence) of every combination with 10 bad URLs, without those a part of which is as sure."""
    sets = {}
    for own, bad in labelled:
        for size in range(1, len(own) + 1):
            for part in itertools.combinations(sorted(own), size):
                n, k = sets.get(part, (0, 0))
                sets[part] = n + 1, k + bad
    sure = {p: (k / len(labelled), k / n) for p, (n, k) in sets.items() if k >= url_rules.LEAST_COUNT and k / len(labelled) >= least_support and k / n >= least_confidence}
    parts = lambda p: (q for size in range(1, len(p)) for q in itertools.combinations(p, size))
    return {p: v for p, v in sure.items() if not any(q in sure and sure[q][1] >= v[1] for q in parts(p))}


def test_mined_rules_match_brute_force(spark, monkeypatch):
    draw = random.Random(8)
    urls = [f"http://{draw.choice(['a', 'b', 'spam'])}.{draw.choice(['com', 'net'])}/{draw.choice(['x', 'y'])}/{i}?{draw.choice(['p', 'q'])}=1" for i in range(400)]
    bad = lambda u: "spam" in u and ".net" in u or "b.com/y" in u and hash_of(u) % 20 > 0
    hash_of = lambda u: int(hashlib.md5(u.encode()).hexdigest(), 16)
    frame = spark.createDataFrame([(u, bad(u)) for u in urls] + [(None, True), (urls[0], None)], "url string, bad boolean")
    rules = url_rules.mine_rules(frame, 0.01, 0.9)
    tokens = {r["url"]: r["t"] for r in frame.where("url is not null").select("url", url_rules.url_tokens(F.col("url")).alias("t")).collect()}
    want = naive_rules([(tokens[u], bad(u)) for u in urls], 0.01, 0.9)
    # a rule of items stands for all rules that take one token of each
    found = {tuple(sorted(p)): (r["support"], r["confidence"]) for r in rules.collect() for p in itertools.product(*r["tokens"])}
    assert any(len(t) > 1 for r in rules.collect() for t in r["tokens"])
    assert found.keys() == want.keys() and all(np.allclose(found[k], want[k]) for k in found)
    for broadcast in (10_000, 0):
        monkeypatch.setattr(url_rules, "MOST_BROADCAST", broadcast)
        hit = {r["url"]: r["n_rules"] for r in url_rules.matched_urls(frame, rules).collect()}
        items = [[set(t) for t in r["tokens"]] for r in rules.collect()]
        assert hit == {u: n for u in urls if (n := sum(all(t & set(tokens[u]) for t in k) for k in items))}
        assert hit.keys() == {u for u in urls if any(set(k) <= set(tokens[u]) for k in want)}
    assert url_rules.mine_rules(frame.where("false")).isEmpty()


def test_shared_long_paths_and_few_urls(spark):
    """Two thousand URLs that share a path of 20 segments and 12 query keys are mined in seconds; what nine URLs have is no rule."""
    path, keys = "/".join(f"s{chr(97 + i)}" for i in range(20)), "&".join(f"k{chr(97 + i)}=1" for i in range(12))
    rows = [(f"http://deep.org/{path}/{i}?{keys}", i % 50 > 0) for i in range(2000)] + [(f"http://few.org/x/{i}", True) for i in range(9)] + [(f"http://ten.org/y/{i}", True) for i in range(10)]
    began = time.perf_counter()
    rules = url_rules.mine_rules(spark.createDataFrame(rows + [(f"http://ok.org/z/{i}", False) for i in range(500)], "url string, bad boolean"), 0.0)
    found = [{t for item in r["tokens"] for t in item} for r in rules.collect()]
    assert time.perf_counter() - began < 60 and len(found) == 2
    assert any({"path=sa", "path=st", "key=kl", "host=deep"} <= f for f in found) and any({"host=ten", "path=y"} <= f for f in found) and not any("host=few" in f for f in found)


def test_mined_rules_decide_unlisted_urls(spark):
    """A planted kind of unlisted URL is blocked by what the listed verdicts teach; without the miner it is not."""
    listed = [url_rules.HostRule("bad.org", "/", "block"), url_rules.HostRule("good.org", "/", "allow")]
    urls = [f"http://{h}.org/{p}/{i}" for i in range(50) for h, p in (("bad", "casino"), ("good", "news"), ("good", "sport"))] + ["http://new.info/casino/1", "http://new.info/news/1", "", "x"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id bigint, url string").withColumns({"hit": F.lit(1), "HOST": F.lit("clash")})
    verdict = url_rules.listed_rule(url_rules.host_of(F.col("url")), url_rules.path_of(F.col("url")), listed)[1]
    rules = url_rules.mine_rules(pages.select("url", (verdict == "block").alias("bad")))
    got = {r["url"]: r["verdict"] for r in url_rules.judge_urls(pages, listed, rules).collect()}
    assert [got[u] for u in urls[-4:]] == ["block", "allow", "allow", "allow"]
    assert all(got[u] == ("block" if "bad.org" in u else "allow") for u in urls[:-4])
    off = {r["url"]: r["verdict"] for r in url_rules.judge_urls(pages, listed, rules.where("false")).collect()}
    assert off["http://new.info/casino/1"] == "allow"
    assert url_rules.judge_urls(pages.where("false"), listed, rules).isEmpty()


# --- very long texts ----------------------------------------------------------------------------


def test_very_long_texts(spark):
    """One text of 120,000 words, one of a single word of 400 kB, among short ones, through every text operator."""
    draw = random.Random(12)
    words = [f"w{draw.randrange(5000)}" for _ in range(120_000)]
    copy = list(words)
    for i in range(0, 120_000, 1000):
        copy[i] = "changed"
    rows = [(1, " ".join(words)), (2, " ".join(copy)), (3, "x" * 400_000), (4, "short text of a few words"), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s")})
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.ngram_join(docs).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}
    bench = spark.createDataFrame([(1, " ".join(words[77_000:77_030]))], "item_id bigint, text string")
    found = {r["doc_id"]: (r["n_words"], r["n_hit"]) for r in decontaminate.find_passages(docs, bench).collect()}
    assert found[1] == (120_000, 30) and found[2][0] == 120_000 and found[2][1] >= 20 and found[3] == (1, 0) and found[5] == (0, 0)
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 1), (4, 1, 0)], "doc_id bigint, quality int, toxic int")
    assert toxicity.drop_toxic(docs, labels).count() == 5 and quality_resampling.resample_quality(docs, labels).count() == 5
    assert lang_id.predict_language(docs, lang_id.fit_codes(docs)).where("lang_pred = 'en'").count() == 4
    sizes = {r["doc_id"]: r["size"] for r in mixing.mix_sources(docs).collect()}
    assert sizes == {1: 120_000, 2: 120_000, 3: 1, 4: 6, 5: 0}
    counts = {r["doc_id"]: (r["n_words"], r["n_repeat_words"]) for r in quality_rules.apply_rules(docs).collect()}
    assert counts[3] == (1, 0) and counts[1] == (120_000, brute_rules(rows[0][1])[4])
    pages = docs.select(F.col("doc_id").alias("record_id"), F.lit("u").alias("url"), F.col("text").alias("payload"))
    index = warc.write_bundles(warc.payload_roles(pages), scratch(spark, "warc"))
    assert {r["record_id"]: r["payload_bytes"] for r in warc.fetch_records(index).collect()} == {i: len(t or "") for i, t in rows}
    turns = docs.select(F.lit(1).alias("conv_id"), F.col("doc_id").alias("turn"), F.lit("user").alias("role"), "text")
    read = chat.format_chat(turns.withColumn("conv_id", F.col("conv_id").cast("bigint"))).select(chat.read_chat(F.col("formatted")).alias("turns")).first()["turns"]
    assert [t["text"] for t in read] == [t or "" for _, t in rows]


# --- pipeline -----------------------------------------------------------------------------------


def test_pipeline(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        names.append(name)
        if name != "mixing":
            assert out.columns == docs.columns
            assert out.select("doc_id").exceptAll(docs.select("doc_id")).isEmpty()
        path = scratch(spark, "stage")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    assert docs.count() > 0 and len(names) == 5
    assert docs.groupBy("doc_id").count().where("count > 1").isEmpty()


def test_columns_called_like_the_operators_own(spark):
    docs = spark.createDataFrame([(1, "the words of a text " * 20, "mine", "mine", "mine")], "doc_id bigint, text string, words string, lines string, __words string")
    out = quality_rules.apply_rules(docs).first()
    assert out["words"] == out["lines"] == out["__words"] == "mine" and out["n_words"] == 100
    other = quality_rules.apply_rules(docs.withColumn("text", F.lit("blabla ble " * 50)), (quality_rules.Rule("stop_word_share", 0.01),), ("ble",)).first()
    assert other["n_stop_words"] == 50
