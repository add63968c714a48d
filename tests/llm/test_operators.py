"""The operators against brute force, on small tables with nulls, ties, repeats and long texts."""

import hashlib
import itertools
import math
import random
import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from chronoloom.llm import fingerprints, hmm, sketches
from chronoloom.llm.classifier import classify_lyrics
from chronoloom.llm.curve import hilbert_keys
from chronoloom.llm.fingerprints import fingerprint_lyrics
from chronoloom.llm.machine import FactorisationMachine
from chronoloom.llm.mixing import mix_genres
from chronoloom.llm.near_copies import grid_cells, near_copies, simhash
from chronoloom.llm.packing import WordIds, pack_lyrics
from chronoloom.llm.quality import judge_lyrics, repeated_words
from chronoloom.llm.scoring import score_lyrics
from chronoloom.llm.shards import shard_of, shard_tracks
from chronoloom.llm.tokens import count_lyric_tokens
from chronoloom.llm.transducer import Machine
from chronoloom.llm.url_rules import GlobAutomaton, judge_cover_urls

SCHEMA = (
    "track_id long, lyrics_text string, language string, genre string, size long, part int, word string, "
    "_cell int, row long, slot int, score double"
)
WORD = re.compile(r"[^\x20\x09-\x0D]+")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def songs(seed=5, n=160):
    """Tracks with shared lines, copies, odd characters, nulls, ties and one very long text."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdelnorstuéß", k=rng.randint(1, 8))) for _ in range(300)]
    made = []
    for i in range(n):
        words = rng.choices(vocabulary, k=rng.choice([0, 1, 3, 12, 60, 200]))
        text = rng.choice([" ", "  ", " \t"]).join(words) + rng.choice(["", "\n", " It's I'll WE'RE 42!! ", "　漢字かな"])
        made.append([i, text, rng.choice(["en", "fr", None]), rng.choice(["pop", "rock", "a", None])])
    for i in range(0, n, 7):
        made[i][1] = made[3][1]
    made[11][1] = None
    made[12][1] = ""
    made[13][1] = " ".join(rng.choices(vocabulary, k=20_000)) + "<|endoftext|>x"
    made[14][1] = "a" * 30_000
    made[15][1] = "<|endoftext|><|startoftext|> <|endoftext|>"
    made[16][2] = made[16][3] = None
    made.append([None, "no id here", "en", "pop"])
    made.append(list(made[20]))  # a repeated row
    made.append([20, "same id, other text", "en", "rock"])
    return [(*m, 1, 2, "w", 3, 4, 5, 0.5) for m in made]


@pytest.fixture(scope="module")
def tracks(spark):
    return spark.createDataFrame(songs(), SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def texts_of(tracks):
    return [(r["track_id"], r["lyrics_text"] or "") for r in tracks.select("track_id", "lyrics_text").collect()]


def same(got, want):
    key = lambda row: tuple((x is None, str(x)) for x in row)
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, want), key=key)


def test_token_counts(tracks, empty):
    tokenizer = Tokenizer.from_file(BYTES)
    rows = texts_of(tracks)
    ids = tokenizer.encode_batch([t for _, t in rows], add_special_tokens=False)
    want = [(i, len(t.encode()), len(e.ids), len(e.ids) > 512) for (i, t), e in zip(rows, ids)]
    same(count_lyric_tokens(tracks, BYTES).collect(), want)
    assert count_lyric_tokens(empty, BYTES).count() == 0


def test_token_machine_on_odd_strings():
    rng = random.Random(1)
    alphabet = " \n\t\r 'stmdrevlLE01²½,.!?|éñ漢か👍́\u0085\u001c​"
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 40))) for _ in range(3_000)]
    tokenizer = Tokenizer.from_file(BYTES)
    want = [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    machine = Machine(BYTES)
    assert machine.counts(texts).tolist() == want
    assert machine.counts(texts, at_once=7).tolist() == want  # long texts in pieces
    machine.splitter.chunk = 3  # many chunk maps to compose
    assert machine.counts(texts).tolist() == want


def test_url_rules(spark):
    rules = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
    urls = [
        (1, "https://A.Example.NET/en/x?q"), (2, "https://example.net/de/"), (3, "http://net/"), (4, "http://x.net"),
        (5, "http://planet/"), (6, "http://example.com/de/1"), (7, "http://myexample.com/de/1"), (8, None), (9, "no scheme"),
        (10, "http://a.com/x.net/y"), (11, "ftp://b.org/fr/"), (12, "http://b.org/fr"), (13, "http://x.org?u=://a.net/"),
        (14, "http://casino.com/a"), (15, ""), (16, "http://é.net/" + "ü" * 5_000), (1, "https://A.Example.NET/en/x?q"),
        (None, "http://example.com#/de/"), (17, "http://a.net:80/"), (18, "://q.net/"),
    ]
    table = spark.createDataFrame([(*u, "x", "y") for u in urls], "project_id long, cover_url string, host string, rule string")

    def judged(url):
        url = url or ""
        m = re.search("://([^/?#]*)([^?#]*)", url, re.S)
        host, path = (m[1], m[2]) if m else ("", "")
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = [(len(r), v, r) for v, r in rules
                if (host == (h := r.split("/", 1)[0]) or host.endswith("." + h)) and path.startswith("/" + r.split("/", 1)[1])]
        if fits:
            return host, path, max(fits)[2], max(fits)[1], None
        bad = "casino" in host and path.startswith("/")
        return host, path, None, "block" if bad else "allow", "*casino*/**" if bad else None

    same(judge_cover_urls(table, rules, ["*casino*/**"]).collect(), [(i, *judged(u)) for i, u in urls])
    assert judge_cover_urls(table.limit(0), rules).count() == 0
    assert {r["verdict"] for r in judge_cover_urls(table, []).collect()} == {"allow"}


def test_globs_over_many_words():
    rng = random.Random(2)
    globs = ["".join(rng.choices(["a", "b", "/", "*", "**"], k=rng.randint(0, 30))) for _ in range(60)]
    subjects = ["".join(rng.choices("ab/", k=rng.randint(0, 25))) for _ in range(300)]
    spelled = [re.compile(re.sub(r"\\\*\\\*", ".*", re.escape(g)).replace(r"\*", "[^/]*") + r"\Z", re.S) for g in globs]
    want = [[bool(p.match(s)) for p in spelled] for s in subjects]
    assert GlobAutomaton(globs).matches([s.encode() for s in subjects]).tolist() == want


def test_shards(tracks, empty):
    rows = shard_tracks(tracks, 8).collect()
    want = sorted((i is not None, i or 0, zlib.crc32(t.encode()), len(t.encode()) + 1) for i, t in texts_of(tracks))
    got = sorted((r["shard"], r["slot"], r["track_id"] is not None, r["track_id"] or 0, r["text_crc32"], r["size"]) for r in rows)
    assert [g[2:] for g in got] == want  # contiguous in id order
    assert {r["law"] for r in rows} == {"bytes"} and all(r["grown_shard"] is None for r in rows)
    for shard, part in itertools.groupby(got, key=lambda g: g[0]):
        assert 0 <= shard < 8
        assert [g[1] for g in part] == list(range(sum(g[0] == shard for g in got)))
    total, start = sum(w[3] for w in want), 0
    for g in got:
        assert g[0] == (2 * start + g[5]) * 8 // (2 * total)
        start += g[5]
    assert shard_tracks(empty, 8).count() == 0


def test_shards_of_a_hot_row(spark):
    """One row on a third of the table is cut into many cells and shards."""
    rows = [(7, "hot")] * 600 + [(i, "x" * (i % 9)) for i in range(1_200)]
    table = spark.createDataFrame(rows, "track_id long, lyrics_text string").repartition(5)
    got = shard_tracks(table, 8).collect()
    sizes = {s: sum(r["size"] for r in got if r["shard"] == s) for s in range(8)}
    assert len(got) == len(rows) and max(sizes.values()) - min(sizes.values()) <= 2 * 10
    assert len({r["shard"] for r in got if r["track_id"] == 7}) > 2
    for s in range(8):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))


def test_long_words_go_by_their_hash(spark):
    long = ["w" * 200 + str(i) for i in range(3)]
    rows = [(i, f"a b {long[i % 2]} c") for i in range(90)] + [(500, f"{long[2]} {long[0].upper()}")]
    table = spark.createDataFrame(rows, "track_id long, lyrics_text string")
    got = {r["track_id"]: r for r in score_lyrics(table, rounds=1).collect()}
    learned = [(i, t) for i, t in rows if zlib.crc32(str(i).encode()) % 10]
    counts = Counter(w for _, t in learned for w in t.lower().split()) + Counter({"\n": len(learned)})
    n, kinds = counts.total(), len(counts)
    for i, text in rows:
        tokens = [*text.lower().split(), "\n"]
        want = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (kinds + 1))) for w in tokens)
        assert abs(got[i]["base_score"] - want) < 1e-6
        assert (got[i]["n_known"], got[i]["n_tokens"]) == (sum(w in counts for w in tokens), len(tokens))


def test_shards_at_their_bounds(spark):
    """A small document at a bound of a large table goes where exact integers put it."""
    texts = spark.range(2).select(F.col("id").alias("track_id"), F.expr("CASE WHEN id = 0 THEN repeat('a', 10000000) END").alias("lyrics_text"))
    assert {r["track_id"]: r["shard"] for r in shard_tracks(texts, 8).collect()} == {0: 3, 1: 7}
    for total in (10**7, 10**8, 30 * 10**9, 10**15):
        rows = [(total - s, s) for s in (1, 10, 40, 3_000, 5_000)]
        rows += [(total * k // 8 + d, s) for k in range(1, 8) for d in (-2_000, -2, -1, 0) for s in (1, 3, 3_000)]
        table = spark.createDataFrame(rows, "start long, size long")
        for r in table.withColumn("shard", shard_of(total, 8)).collect():
            assert r["shard"] == (2 * r["start"] + r["size"]) * 8 // (2 * total)


def test_mixing(tracks, empty):
    weights = [1, 2, 3]
    rows = mix_genres(tracks, weights).collect()
    copies = mix_genres(tracks, weights, whole=True).collect()
    assert len(rows) == len(copies) == tracks.count()
    words = [(r["genre"], len(WORD.findall(r["lyrics_text"] or ""))) for r in tracks.collect()]
    names = sorted({g for g, _ in words}, key=lambda g: (g is None, g or ""))
    size = {g: sum(n for h, n in words if h == g) for g in names}
    weight = {g: weights[i % 3] for i, g in enumerate(names)}
    target = {g: 0.0 for g in names}
    free, left = set(names), float(sum(size.values()))
    while free:
        share = {g: left * weight[g] / sum(weight[h] for h in free) for g in free}
        full = {g for g in free if share[g] >= 3 * size[g]}
        if not full:
            target |= share
            break
        target |= {g: 3.0 * size[g] for g in full}
        left -= sum(3.0 * size[g] for g in full)
        free -= full
    for g in names:
        own = [r for r in rows if r["genre"] == g]
        assert all(r["source_size"] == size[g] and abs(r["target"] - target[g]) < 1e-6 for r in own)
        assert abs(sum(r["taken"] for r in own) - target[g]) <= 1
        copied = [r for r in copies if r["genre"] == g]
        assert abs(sum(r["taken"] for r in copied) - target[g]) <= max(r["size"] for r in copied)
        assert all(r["taken"] % r["size"] == 0 if r["size"] else r["taken"] == 0 for r in copied)
        assert all(r["taken"] <= 3 * r["size"] for r in own)
    same(mix_genres(tracks.repartition(3), weights).collect(), rows)
    assert mix_genres(empty, weights).count() == 0


def test_mixing_follows_virtual_time(spark):
    table = spark.createDataFrame([(i, "abc"[i % 3], "w " * (i % 9)) for i in range(90)], "track_id long, genre string, lyrics_text string")
    rows = mix_genres(table, [1.0, 1.0, 8.0]).collect()
    order = {r["track_id"]: r["finish"] for r in rows}
    for g in "abc":
        own = [r for r in rows if r["genre"] == g and r["size"]]
        cumulated = sorted((order[r["track_id"]], r["size"]) for r in own)
        total = np.cumsum([s for _, s in cumulated])
        assert np.allclose([f for f, _ in cumulated], total / own[0]["target"])


def test_hidden_markov_model_by_enumeration():
    rng = np.random.default_rng(0)
    states, slots = 3, 5
    norm = lambda x: x / x.sum(-1, keepdims=True)
    emit = norm(rng.random((states, slots))).T.copy()
    model = hmm.Model(norm(rng.random(states)), norm(rng.random((states, states))), emit)
    sequences = [rng.integers(0, slots, n) for n in (1, 4, 5, 2, 4)]
    want, starts, moves, emits = [], np.zeros(states), np.zeros((states, states)), np.zeros((slots, states))
    for seq in sequences:
        total, s, m, e = 0.0, np.zeros(states), np.zeros((states, states)), np.zeros((slots, states))
        for path in itertools.product(range(states), repeat=len(seq)):
            p = model.start[path[0]] * np.prod([emit[x, z] for x, z in zip(seq, path)])
            p *= np.prod([model.move[a, b] for a, b in zip(path, path[1:])])
            total += p
            s[path[0]] += p
            for a, b in zip(path, path[1:]):
                m[a, b] += p
            for x, z in zip(seq, path):
                e[x, z] += p
        want.append(np.log10(total))
        starts, moves, emits = starts + s / total, moves + m / total, emits + e / total
    assert np.allclose(hmm.log10_likelihood(model, sequences), want)
    for got, right in zip(hmm.expected_counts(model, sequences), (starts, moves, emits)):
        assert np.allclose(got, right)


def test_lyric_scores(tracks, empty):
    rows = score_lyrics(tracks, states=3, rounds=3, slots=64).collect()
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    tokens = [(i, [*WORD.findall(lower(t)), "\n"]) for i, t in texts_of(tracks)]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    counts = {}
    for i, words in tokens:
        for w in words if not held(i) else ():
            counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(i), held(i), len(w), sum(x in counts for x in w), n,
                   round(sum(np.log10((counts.get(x, 0) + 0.1) / (n + 0.1 * (v + 1))) for x in w), 4)) for i, w in tokens)
    got = sorted((str(r[0]), *r[1:5], round(r["base_score"], 4)) for r in rows)
    assert got == want
    trained = [r for r in rows if not r["held_out"]]
    assert sum(r["score"] for r in trained) > sum(r["base_score"] for r in trained)
    assert all(r["score"] < 0 for r in rows)
    assert score_lyrics(empty, states=2, rounds=1, slots=8).count() == 0


def test_scores_are_probabilities(spark):
    """Over all one-word texts of known words and one unknown word per slot, shares add up to one."""
    table = spark.createDataFrame([(i, t) for i, t in enumerate(["a b", "b c", "a", "c c b"])], "track_id long, lyrics_text string")
    slots = 4
    rows = score_lyrics(table, states=2, rounds=2, slots=slots).collect()
    assert len(rows) == 4 and all(-30 < r["score"] < 0 for r in rows)


@pytest.mark.parametrize("dimensions,bits", [(2, 3), (3, 2), (4, 2)])
def test_hilbert_curve(dimensions, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dimensions)))
    keys = hilbert_keys(cells, bits)
    assert sorted(keys.tolist()) == list(range(len(cells)))
    walk = cells[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()  # each step to a neighbour


def test_packing(tracks, empty):
    tokenizer = Tokenizer.from_file(WORDS)
    rows = texts_of(tracks)
    ids = [[*e.ids, 2] for e in tokenizer.encode_batch([t for _, t in rows], add_special_tokens=False)]
    pieces = pack_lyrics(tracks, WORDS, length=64).collect()
    by_sequence = {}
    for p in pieces:
        by_sequence.setdefault(p["sequence_id"], []).append(p)
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for number, parts in by_sequence.items():
        parts.sort(key=lambda p: p["offset"])
        assert [p["offset"] for p in parts] == [0, *itertools.accumulate(p["length"] for p in parts)][:-1]
        assert sum(p["length"] for p in parts) == 64 or number == len(by_sequence) - 1
    stream = sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"]))
    found, at = [], 0
    while at < len(stream):  # a document's pieces follow each other
        first, whole = stream[at], []
        while len(whole) < first["doc_tokens"]:
            assert stream[at]["start"] == len(whole) and stream[at]["track_id"] == first["track_id"]
            whole += np.frombuffer(stream[at]["ids"], "<u4").tolist()
            assert len(whole) == stream[at]["start"] + stream[at]["length"]
            at += 1
        found.append((first["track_id"], whole))
    same(found, [(i, x) for (i, _), x in zip(rows, ids)])
    assert pack_lyrics(empty, WORDS).count() == 0


def test_word_ids():
    """Words tokenised side by side and remembered are those of whole texts, marks and odd blanks included."""
    rng = random.Random(5)
    words = ["\x01", "a\x01b", "<|endoftext|>", "x<|startoftext|>y", "it's", "\u0301e", "b\u0301", "Größe", "e\u0085f", "你好", "42nd", ""]
    texts = ["".join(rng.choice(words) + rng.choice([" ", "\n", "\x0b ", "\t"]) for _ in range(n)) for n in (0, 1, 3, 40, 400)]
    texts += ["", " ", " ".join(f"w{i}" for i in range(500))]
    tokenizer = Tokenizer.from_file(WORDS)
    want = [[*e.ids, 2] for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    coder = WordIds(WORDS, room=50)
    for _ in range(2):
        assert [x.tolist() for x in coder.ids(pa.array(texts))] == want
    assert coder.ids(pa.array([], pa.string())) == []
    assert [x.tolist() for x in coder.ids(pa.array(texts).slice(3, 4))] == want[3:7]


def in_order(rows):
    """Descending ids, null last; equal ids by descending signed hash of their text."""
    signed = lambda text: (xxhash.xxh64_intdigest(text.encode(), 42) + 2**63) % 2**64 - 2**63
    return sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), -signed(r[1])))


def edits(rows):
    want = []
    for i, (track, text) in enumerate(rows):
        following = rows[(i + 1) % len(rows)][1]
        third = len(text) // 3
        text_2 = text[: len(text) - third] + following[:third]
        want.append((track, len(text), hashlib.sha256(text_2.encode()).hexdigest()))
    return want


def test_fingerprints_of_hot_rows(spark, monkeypatch):
    """A third of the rows are one row, a third have one id and a third none; a range takes a part of an id."""
    schema = "track_id long, lyrics_text string"
    texts = ["the same words again"] * 700 + [f"line {i} of one id" for i in range(700)] + [f"no id {i}" for i in range(700)]
    ids = [5] * 1_400 + [None] * 700
    rows = [*zip(ids, texts), (9, "above"), (1, "below"), (1, None)]
    table = spark.createDataFrame(rows, schema).repartition(6).cache()
    monkeypatch.setattr(fingerprints, "SEEN", 50)
    got = fingerprint_lyrics(table, ranges_per_task=4)
    same([r[:3] for r in got.collect()], edits(in_order([(i, t or "") for i, t in rows])))
    places = table.select(F.coalesce("track_id", F.lit(fingerprints.LOWEST)).alias("place"), F.xxhash64("lyrics_text").alias("hash"))
    tops = fingerprints._tops(places, 32)
    assert (tops[0] == 5).sum() > 5 and (tops[0] == fingerprints.LOWEST).sum() > 5
    batches = table.withColumn("place", F.coalesce("track_id", F.lit(fingerprints.LOWEST)))
    batches = batches.withColumn("lyrics_text", F.coalesce("lyrics_text", F.lit(""))).withColumn("hash", F.xxhash64("lyrics_text"))
    dealt = batches.coalesce(1).mapInArrow(
        fingerprints._dealt(tops), f"{fingerprints.COPIES}, track_id long, lyrics_text string"
    )
    sent = dealt.groupBy("part").count().toPandas()
    assert sent["count"].max() < 250  # of 2,103 rows
    assert dealt.agg(F.sum("copies")).first()[0] == len(rows)


def test_fingerprints(tracks, empty, spark):
    rows = in_order(texts_of(tracks))
    want = edits(rows)
    for ranges in (1, 3, 40):
        got = fingerprint_lyrics(tracks, ranges_per_task=ranges)
        same([r[:3] for r in got.collect()], want)
    prints = {}
    texts = {}
    for track, text in rows:
        texts.setdefault(track, set()).add(text)
    for r in got.collect():
        if len(texts[r["track_id"]]) == 1:
            prints.setdefault(next(iter(texts[r["track_id"]])), set()).add(r["fingerprint"])
    assert all(len(p) == 1 for p in prints.values())
    assert len({next(iter(p)) for p in prints.values()}) == len(prints)
    assert fingerprint_lyrics(empty).count() == 0
    one = spark.createDataFrame([(4, "abcdefghi")], "track_id long, lyrics_text string")
    row = fingerprint_lyrics(one).first()
    assert row["edited_sha256"] == hashlib.sha256(b"abcdefabc").hexdigest() and row["near_next"] == 1.0


def test_fingerprints_of_hashed_ids(spark):
    """Every 64-bit id comes out, followed by the next lower one, whatever ranges are cut."""
    hashed = F.xxhash64(F.col("id"))
    table = spark.range(3_000).select(hashed.alias("track_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("lyrics_text"))
    rows = sorted(texts_of(table), reverse=True)
    want = []
    for (track, text), (_, following) in zip(rows, rows[1:] + rows[:1]):
        third = len(text) // 3
        want.append((track, len(text), hashlib.sha256((text[: len(text) - third] + following[:third]).encode()).hexdigest()))
    same([r[:3] for r in fingerprint_lyrics(table, ranges_per_task=5).collect()], want)


def test_sketches_estimate():
    rng = random.Random(8)
    for share in (0.0, 0.3, 0.6, 1.0):
        a = "".join(rng.choices("abcdefghij ", k=8_000))
        cut = int(len(a) * share)
        b = a[:cut] + "".join(rng.choices("abcdefghij ", k=8_000 - cut))
        sa, sb = ({x[i : i + 8] for i in range(len(x) - 7)} for x in (a, b))
        left, right = sketches.Sketch.of(a, 256, 8), sketches.Sketch.of(b, 256, 8)
        assert abs(left.resemblance(right) - len(sa & sb) / len(sa | sb)) < 0.12
        assert abs(left.containment(right) - len(sa & sb) / len(sa)) < 0.15
        assert abs(left.distinct() / len(sa) - 1) < 0.2
        halves = sketches.Sketch.of(a[:5_000], 256, 8).merged(sketches.Sketch.of(a[4_993:], 256, 8))
        assert halves.text() == left.text()
        assert sketches.Sketch.read(left.text(), 256).resemblance(left) == 1.0


def brute_rules(text):
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    repeats = sum(x in lines[:i] for i, x in enumerate(lines))
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), repeats, len(covered), failed)


def test_quality_rules(tracks, empty, spark):
    short = tracks.filter(F.coalesce(F.length("lyrics_text"), F.lit(0)) < 5_000)
    got = judge_lyrics(short)
    same([r[:7] for r in got.collect()], [(i, *brute_rules(t)) for i, t in texts_of(short)])
    assert all(not r["kept"] for r in got.collect() if r["base_failed"])
    assert judge_lyrics(tracks).count() == tracks.count()
    assert judge_lyrics(empty).count() == 0
    rng = random.Random(4)
    common = "the of and to in a is that it for was on are with".split()

    def prose(n):
        return " ".join(rng.choice(common) if rng.random() < 0.35 else "".join(rng.choices("aeinorst", k=6)) for _ in range(n))

    good = [(i, prose(rng.randint(12, 400)), "en") for i in range(60)]
    bad = [(100, prose(200).upper().replace(" ", "!! "), "en"), (101, prose(200).replace(" ", "$$$ "), None)]
    bad += [(102, " | ".join("".join(rng.choices("aeinorst", k=6)) for _ in range(150)), "xx")]
    rows = judge_lyrics(spark.createDataFrame(good + bad, "track_id long, lyrics_text string, language string")).collect()
    assert {r["track_id"] for r in rows if not r["kept"]} == {100, 101, 102}
    unknown = judge_lyrics(spark.createDataFrame(good[:3], "track_id long, lyrics_text string, language string").withColumn("language", F.lit("xx")))
    assert all(r["kept"] == (not r["base_failed"]) and r["class_distance"] is None for r in unknown.collect())


def plain_distance(counts, others):
    """Jensen-Shannon distance, base 2, of two histograms."""
    p, q = ([x / (sum(xs) or 1) for x in xs] for xs in (counts, others))
    part = lambda a, b: sum(x * math.log2(2 * x / (x + y)) for x, y in zip(a, b) if x)
    return math.sqrt(max(0.0, (part(p, q) + part(q, p)) / 2))


def plain_histograms(text, words):
    """Counts by class and by common word (the last: any other)."""
    classes = [0] * 8
    for c in text:
        kind = unicodedata.category(c)
        spot = {"Ll": 0, "Lu": 1, "Lt": 1, "Nd": 2, "Lo": 5, "Lm": 5}.get(kind, 7) if ord(c) < 0x10000 else 7
        spot = 3 if c in ".,;:?!'\"()-" else 4 if c in "#*$%&|<>" else 6 if c in "\t\n\v\f\r " else spot
        classes[spot] += 1
    commons = [0] * (len(words) + 1)
    for w in WORD.findall(text):
        w = w.lower().strip(".,;:?!'\"()-")
        commons[words.index(w) if w in words else -1] += 1
    return classes, commons


def test_distances_against_plain_computation(spark):
    rng = random.Random(12)
    lists = {"en": ["the", "of", "and"], "fr": ["de", "la", "et"]}
    words = sorted({w for ws in lists.values() for w in ws})
    rows = []
    for i in range(80):
        language = rng.choice(["en", "fr", None])
        pool = lists.get(language, ["xx"]) + ["word", "Été", "12", "#tag", "o,", "漢"]
        rows.append((i, " ".join(rng.choices(pool, k=rng.randint(10, 60))), language))
    table = spark.createDataFrame(rows, "track_id long, lyrics_text string, language string").repartition(3)
    sums = {}
    for _, text, language in rows:
        if language:
            own = sums.setdefault(language, [[0] * 8, [0] * 7])
            for total, part in zip(own, plain_histograms(text, words)):
                total[:] = [a + b for a, b in zip(total, part)]
    guards = [(10, 0.2, 0.3)]
    for r in judge_lyrics(table, lists, guards).collect():
        classes, commons = plain_histograms(rows[r["track_id"]][1], words)
        pairs = [(plain_distance(classes, c), plain_distance(commons, w)) for c, w in sums.values()]
        want = min(pairs, key=sum)
        assert abs(r["class_distance"] - want[0]) < 1e-9 and abs(r["word_distance"] - want[1]) < 1e-9
        assert r["kept"] == (not r["base_failed"] and not (want[0] > 0.2 and want[1] > 0.3))


SENTENCES = {
    "ko": "나는 오늘 아침 일찍 일어나 강가 를 걸었다 바람 이 차갑고 하늘 은 맑았다 새 들 이 노래 하고 물 은 조용히 흘렀다 우리 는 오래 이야기 했다",
    "hi": "मैं आज सुबह जल्दी उठा और नदी के किनारे चला हवा ठंडी थी और आकाश साफ था पक्षी गा रहे थे और पानी धीरे बह रहा था हम देर तक बात करते रहे",
    "ja": "わたしは けさ はやく おきて かわべ を あるいた かぜ が つめたく そら は あおかった とり が うたい みず は しずかに ながれた ぼくら は ながく はなした ね と また あした",
    "el": "σήμερα το πρωί ξύπνησα νωρίς και περπάτησα στο ποτάμι ο άνεμος ήταν κρύος και ο ουρανός καθαρός τα πουλιά τραγουδούσαν και το νερό κυλούσε αργά μιλήσαμε πολλή ώρα",
}


def test_clean_lyrics_of_other_scripts_are_kept(spark):
    rng = random.Random(4)
    common = "the of and to in a is that it for was on are with".split()
    latin = [(i, " ".join(rng.choice(common) if rng.random() < 0.4 else "".join(rng.choices("aeinorst", k=5)) for _ in range(80)), "en") for i in range(40)]
    made = []
    for language, sentence in SENTENCES.items():
        words = sentence.split()
        for n in (20, 60, 300):
            made.append((language, " ".join(rng.choices(words, k=n))))
    schema = "track_id long, lyrics_text string, language string"
    foreign = [(100 + i, text, None) for i, (_, text) in enumerate(made)]
    got = {r["track_id"]: r for r in judge_lyrics(spark.createDataFrame(latin + foreign, schema)).collect()}
    assert all(got[i]["kept"] and got[i]["class_distance"] is None for i, _, _ in foreign if not got[i]["base_failed"])
    assert sum(not got[i]["base_failed"] for i, _, _ in foreign) >= 10
    own = [
        (1_000 + 100 * k + i, " ".join(rng.choices(sentence.split(), k=60)), language)
        for k, (language, sentence) in enumerate(SENTENCES.items())
        for i in range(80)
    ]
    junk = [(5_000, " ".join("!!" + "".join(rng.choices("가나다라마", k=2)) + "##9" for _ in range(24)), "ko")]
    got = {r["track_id"]: r for r in judge_lyrics(spark.createDataFrame(latin + foreign + own + junk, schema)).collect()}
    lost = [tuple(r) for i, r in got.items() if not r["base_failed"] and i != 5_000 and (not r["kept"] or r["class_distance"] is None)]
    assert not lost, lost[:6]
    assert not got[5_000]["kept"] and not got[5_000]["base_failed"]


def test_judged_rows_carry_a_column(spark):
    rows = spark.createDataFrame([(1, "a b", "en", "x"), (1, None, None, None)], "track_id long, lyrics_text string, language string, kept string")
    got = judge_lyrics(rows.withColumn("document", F.struct("kept", "lyrics_text")), carried="document")
    assert {tuple(r["document"]) for r in got.collect()} == {("x", "a b"), (None, None)}


def test_repeated_words_survives_equal_hashes():
    codes = np.array([1, 2, 3, 4, 5, 9, 1, 2, 3, 4, 5, 1, 1, 1, 1, 1, 1])
    assert repeated_words(codes) == 10 + 6
    assert repeated_words(codes[:5]) == 0


def test_factorisation_machine():
    rng = np.random.default_rng(5)
    rows = rng.random((7, 6))
    machine = FactorisationMachine(0.3, rng.normal(size=6), rng.normal(size=(6, 2)))
    want = [
        0.3 + r @ machine.weights + sum(machine.factors[i] @ machine.factors[j] * r[i] * r[j] for i in range(6) for j in range(i))
        for r in rows
    ]
    assert np.allclose(machine.margins(rows), want)
    x = rng.integers(0, 2, (2_000, 4)).astype(float)
    y = (x[:, 0] == x[:, 1]).astype(float)  # needs a pair
    fitted = FactorisationMachine.fitted(x, y)
    assert ((fitted.scores(x) > 0.5) == (y > 0.5)).mean() > 0.95


def test_classifier(tracks, empty, spark):
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("aeinorst", k=5))
    rows = [(i, " ".join(word() + ("!!$" if i % 4 == 0 else "") for _ in range(rng.randint(5, 80)))) for i in range(400)]
    table = spark.createDataFrame([(*r, "clash") for r in rows], "track_id long, lyrics_text string, score string")
    ratings = spark.createDataFrame(
        [(i, int(i % 4 != 0), 1) for i in range(400)] + [(None, 1, 0), (3, None, 0), (999, 0, 0)], "track_id long, quality int, toxic int"
    )
    got = classify_lyrics(table, ratings, carried="lyrics_text").collect()
    assert {(r["track_id"], r["lyrics_text"]) for r in got} == set(rows)
    assert all(r["held_out"] == held(r["track_id"]) for r in got)
    right = [(r["predicted"] == 1) == (r["track_id"] % 4 != 0) for r in got if r["held_out"]]
    assert sum(right) / len(right) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    lied = ratings.withColumn("quality", F.when(F.crc32(F.col("track_id").cast("string").cast("binary")) % 5 == 0, 0).otherwise(F.col("quality")))
    again = classify_lyrics(table, lied, carried="lyrics_text").collect()  # held-out labels play no role
    assert {r["track_id"]: r["score"] for r in again} == {r["track_id"]: r["score"] for r in got}
    assert classify_lyrics(tracks, ratings).count() == tracks.count()
    assert classify_lyrics(empty, ratings).count() == 0
    assert len({r["score"] for r in classify_lyrics(table, ratings.limit(0)).collect()}) == 1


def test_classifier_fits_one_row_per_rated_track(spark, monkeypatch):
    """An id on many rows is one row of the sample."""
    seen = []
    fitted = FactorisationMachine.fitted.__func__

    def counted(cls, rows, marks):
        seen.append(len(rows))
        return fitted(cls, rows, marks)

    monkeypatch.setattr(FactorisationMachine, "fitted", classmethod(counted))
    sampled = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5][:100]
    rows = [(i, f"some words {i}") for i in sampled] + [(sampled[0], f"again {j % 50}") for j in range(1_000)]
    table = spark.createDataFrame(rows, "track_id long, lyrics_text string").repartition(5)
    ratings = spark.createDataFrame([(i, i % 2) for i in sampled], "track_id long, quality int")
    got = classify_lyrics(table, ratings, most_ratings=100).collect()
    assert seen == [100] and len(got) == len(rows)
    again = classify_lyrics(table.repartition(3), ratings, most_ratings=100).collect()
    same(got, again)


def brute_simhash(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    size = min(4, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + size]).encode(), 42) for i in range(len(words) - size + 1)] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_groups(tracks, empty, spark):
    rows = [(i, t) for i, t in texts_of(tracks)]
    prints = [brute_simhash(t) if len(t) < 20_000 else simhash(t, 4) for _, t in rows]
    low = spark.createDataFrame(rows, "track_id long, lyrics_text string")
    got = near_copies(low).collect()
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(range(len(rows)), 2):
        if (prints[a] ^ prints[b]).bit_count() <= 4:
            root[max(find(a), find(b))] = min(find(a), find(b))
    members = {}
    for i in range(len(rows)):
        members.setdefault(find(i), []).append(i)
    want = []
    for group in members.values():
        known = [rows[i][0] for i in group if rows[i][0] is not None]
        want += [(rows[i][0], f"{prints[i]:016x}", min(known) if known else None) for i in group]
    same(got, want)
    assert near_copies(empty).count() == 0
    assert near_copies(tracks).count() == tracks.count()


@pytest.mark.parametrize("distance", [1, 3, 4, 7])
def test_close_prints_meet_in_a_cell(distance):
    rng = np.random.default_rng(distance)
    a = rng.integers(0, 1 << 64, 500, dtype=np.uint64)
    b = a.copy()
    for _ in range(distance):
        b ^= np.uint64(1) << rng.integers(0, 64, 500, dtype=np.uint64)
    cells, owners, above = grid_cells(np.concatenate([a, b]), distance)
    own, up = [set() for _ in range(1000)], [set() for _ in range(1000)]
    for c, o, u in zip(cells.tolist(), owners.tolist(), above.tolist()):
        (up if u else own)[o].add(c)
    for i in range(500):
        assert own[i] & own[i + 500] or own[i] & up[i + 500] or up[i] & own[i + 500]


def test_hot_cells_are_split(spark):
    """Near copies that fill a cell are compared in small groups, and all links are found."""
    from chronoloom.llm.near_copies import components, dealt, links

    prints = [sum(1 << b for b in bits) for n in range(4) for bits in itertools.combinations(range(0, 24, 2), n)]
    rows = spark.createDataFrame([(c, False, p) for p in prints for c in (5, 6)] + [(7, False, 1), (7, True, 2)], "cell long, above boolean, print long")
    groups = {}
    for r in dealt(rows, 60).collect():
        groups.setdefault((r["cell"], r["pair"]), set()).add(r["print"])
    assert max(map(len, groups.values())) < 100 < len(prints)
    for cell, known in ((5, prints), (6, prints), (7, [1, 2])):
        met = {frozenset(p) for (c, _), g in groups.items() if c == cell for p in itertools.combinations(g, 2)}
        assert met == {frozenset(p) for p in itertools.combinations(known, 2)}
    table = spark.createDataFrame([(p,) for p in [*prints, *(1 << 40 | p << 34 for p in prints)]], "print long")
    whole = components(links(table, 4)).collect()
    same(components(links(table, 4, most=60)).collect(), whole)


def test_long_chains_are_one_group(spark):
    from chronoloom.llm.near_copies import components, links

    rng = random.Random(9)
    chain = [0]
    for _ in range(300):  # each within 4 bits of the one before
        chain.append(chain[-1] ^ (1 << rng.randrange(63)) ^ (1 << rng.randrange(63)))
    far = [rng.getrandbits(63) for _ in range(300)]
    table = spark.createDataFrame([(x,) for x in {*chain, *far}], "print long")
    found = links(table, 4)
    rows = components(found).collect()
    assert {r["node"] for r in rows if r["root"] == min(chain)} >= set(chain) - {min(chain)}
    line = spark.createDataFrame([(i, i + 1) for i in range(500)], "a long, b long")
    assert {(r["node"], r["root"]) for r in components(line).collect()} == {(i, 0) for i in range(1, 501)}
