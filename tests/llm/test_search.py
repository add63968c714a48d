"""Search, token alignment and personal data against plain computations on small tables."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from test_operators import SCHEMA, songs
from tokenizers import Tokenizer

from chronoloom.llm import crosswalk, lexical, private_data
from chronoloom.llm.batches import sliced
from chronoloom.llm.boosting import fit
from chronoloom.llm.crosswalk import align_lyric_tokens, chunks
from chronoloom.llm.lexical import search_lyrics
from chronoloom.llm.private_data import KINDS, find_private_data

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FIRST, SECOND = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def tracks(spark):
    return spark.createDataFrame(songs(), SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def ranked(rows, lines, k):
    """Every track scored for every line."""
    counts = [(i, Counter(TERM.findall(lower(text)))) for i, text in rows]
    n = sum(1 for _, c in counts if c)
    length = sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for line, text in lines:
        scores = []
        for i, c in counts:
            if not c:
                continue
            m = 50 + 50 * c.total() * n // length
            score = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m))
                for t in set(TERM.findall(lower(text)))
                if c[t]
            )
            if score > 0:
                scores.append((-score, i is None, i))
        out += [(line, r, x[2], -x[0]) for r, x in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


LINES = [
    (1, "aé be. CO-do a! ß"),
    (2, None),
    (3, ""),
    (4, "no id here"),
    (4, "no id here"),
    (None, "漢字かな It's 42"),
    (5, "never-met-termx"),
    (6, "a " * 30_000),
]


@pytest.mark.parametrize("k,width,block", [(50, 2048, 1000), (3, 4, 2)])
def test_search(spark, tracks, k, width, block):
    rows = [(r[0], r[1]) for r in tracks.select("track_id", "lyrics_text").collect()]
    words = sorted({w for _, t in rows for w in (t or "").split()})
    rng = random.Random(2)
    lines = LINES + [(100 + i, " ".join(rng.choices(words, k=rng.choice([1, 4, 30])))) for i in range(12)]
    asked = spark.createDataFrame([(*x, 7, 0.5) for x in lines], "line_id long, line_text string, n long, score double")
    got = search_lyrics(tracks, asked, k=k, width=width, most_lines=block)
    assert got.columns == ["line_id", "rank", "track_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == ranked(rows, lines, k)


def test_search_without_rows(spark, tracks, empty):
    lines = spark.createDataFrame(LINES, "line_id long, line_text string")
    assert search_lyrics(empty, lines).count() == 0
    assert search_lyrics(tracks, lines.limit(0)).count() == 0


def test_bounds_prune(monkeypatch, spark):
    """Tracks whose bound lies below the threshold are not rescored."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(2_000)]
    rows = [(i, " ".join(rng.choices(words, k=40)) + (" key lock" if i < 60 else "")) for i in range(4_000)]
    vocabulary = {b"key": 0, b"lock": 1}
    index = lexical.sketched(spark.createDataFrame(rows, "track_id long, lyrics_text string").coalesce(1), vocabulary, 2048)
    batch = index.toArrow().combine_chunks().to_batches()[0]
    line = tuple(np.array(x) for x in ([lexical.slot_of(t, 2048) for t in vocabulary], [0, 1], [5_000, 5_000]))
    asked = []
    search = np.searchsorted
    monkeypatch.setattr(lexical.np, "searchsorted", lambda a, v, *rest: asked.append(len(v)) or search(a, v, *rest))
    best = lexical.Best(50)
    lexical.rescored(batch, [line], [best], 4_000, 160_120, 2048)
    assert len(best.cut()) == 50 and {i for _, i in best.rows} <= set(range(60)) and sum(asked) <= 4 * lexical.STEP


def test_long_texts_are_cut(monkeypatch):
    text = "Aé b-c " * 5_000
    whole = lexical.term_counts(text)
    monkeypatch.setattr(lexical, "PIECE", 11)
    assert lexical.term_counts(text) == whole == Counter({"aé".encode(): 5_000, b"b": 5_000, b"c": 5_000})


def test_slices_by_bytes():
    import pyarrow as pa

    texts = ["x" * 100, None, "", "y" * 5_000, "z" * 40, "z" * 40]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(texts)], ["i", "t"])
    sizes = [b.num_rows for b in sliced([batch, batch.slice(0, 0)], rows=4, size=120)]
    assert sizes == [3, 1, 2, 0]


@pytest.fixture(scope="module")
def libraries():
    first = Tokenizer.from_file(FIRST)
    first.encode_special_tokens = True
    return first, sentencepiece.SentencePieceProcessor(model_file=SECOND)


def token_bytes(libraries):
    first, second = libraries
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    decode = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    a = {i: bytes(decode[c] for c in t) for t, i in first.get_vocab().items()}
    b = {}
    for i in range(second.get_piece_size()):
        piece = second.id_to_piece(i)
        byte = re.fullmatch("<0x(..)>", piece)
        b[i] = bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode()
    return a, b


def groups_of(libraries, tables, text):
    """Ids of both sides, groups as text, linked ids."""
    if not text:
        return [], [], "", []
    raw = (" " + text).encode()
    sides = [libraries[0].encode(" " + text, add_special_tokens=False).ids, libraries[1].encode(text)]
    if any(b"".join(t[i] for i in ids) != raw for t, ids in zip(tables, sides)):
        return [], [], "", []
    ends = [np.cumsum([len(t[i]) for i in ids]).tolist() for t, ids in zip(tables, sides)]
    shown, links, begin = [], [], [0, 0]
    for end in sorted(set(ends[0]) & set(ends[1])):
        upto = [e.index(end) + 1 for e in ends]
        shown.append("|".join(",".join(map(str, ids[b:u])) for ids, b, u in zip(sides, begin, upto)))
        links.append(tuple(ids[u - 1] for ids, u in zip(sides, upto)))
        begin = upto
    return *sides, ";".join(shown), links


ODD = ["a\x00b", "x ▁ y", "<|endoftext|> <s> </s><0x41>", "  two  blanks\t\n\n x ", "é ½² ﬁ ①", "'ll we're I'M", "漢字 かな か゚", "\u0085\xa0 x\xad"]


def test_alignment(spark, tracks, libraries):
    tables = token_bytes(libraries)
    odd = spark.createDataFrame([(900 + i, t) for i, t in enumerate(ODD)], "track_id long, lyrics_text string")
    whole = tracks.unionByName(odd, allowMissingColumns=True)
    rows = [(r[0], r[1]) for r in whole.select("track_id", "lyrics_text").collect()]
    made = [(i, *groups_of(libraries, tables, t)) for i, t in rows]
    counts = Counter(link for row in made for link in row[-1])
    highest = {}
    for (_, b), n in counts.items():
        highest[b] = max(highest.get(b, 0), n)
    want = []
    for i, a, b, shown, links in made:
        best = sum(counts[x] == highest[x[1]] for x in links)
        hashed = hashlib.sha256(shown.encode()).hexdigest() if a else ""
        want.append((i, len(a), len(b), len(links), len(links), best, sum(counts[x] for x in links), hashed))
    got = align_lyric_tokens(whole, FIRST, SECOND)
    assert got.columns == "track_id n_a n_b n_groups n_links n_best count_sum groups_sha256".split()
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert sum(1 for row in want if not row[1]) >= 4  # null, empty, and those that do not join to their bytes


def test_alignment_of_no_rows(empty):
    assert align_lyric_tokens(empty, FIRST, SECOND).count() == 0


def test_chunks_change_no_ids(libraries):
    rng = random.Random(6)
    pools = [[chr(c) for c in range(256)], list("ab' \n\t<|>19▁é漢½"), [" ", "  ", "\n", "a", "é", "'s", "12", "<|endoftext|>", "́", "ﬁ"]]
    walk = crosswalk.crosswalk(FIRST, SECOND)
    for _ in range(1_500):
        text = "".join(rng.choices(rng.choice(pools), k=rng.choice([1, 4, 60])))
        parts = chunks(" " + text, 8)
        assert "".join(parts) == " " + text
        a = [i for p in parts for i in walk.first.ids(p).tolist()]
        b = [i for p in parts for i in walk.second.ids(p[1:]).tolist()]
        assert a == libraries[0].encode(" " + text, add_special_tokens=False).ids and b == libraries[1].encode(text)


def test_windows_are_remembered_and_forgotten(monkeypatch, libraries):
    walk = crosswalk.Crosswalk(FIRST, SECOND)
    first = walk.aligned(["one two three", "one two three four"])
    known = len(walk.memo)
    assert walk.aligned(["three two one"])[0][0] == 3 and len(walk.memo) == known
    monkeypatch.setattr(crosswalk, "MEMO", 1)
    assert walk.aligned(["one two three", "one two three four"]) == first and len(walk.memo) == known


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(number):
    total = 0
    for i, c in enumerate(reversed(number)):
        total += int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10))
    return total % 10 == 0


def base_spans(text):
    found = []
    for rank, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            number = re.sub("[^0-9]", "", m[0])
            if (
                kind == "email"
                or (kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")))
                or (kind == "card" and 12 <= len(number) <= 19 and luhn(number))
                or (kind == "phone" and 9 <= len(number) <= 15)
            ):
                found.append((m.start(), rank, kind, m.end()))
    return [(kind, start, end) for start, _, kind, end in sorted(found)]


def private_rows():
    rng = random.Random(8)
    card = lambda: next(c for c in iter(lambda: "4" + "".join(rng.choices("0123456789", k=15)), 0) if luhn(c))
    bits = [
        lambda: f"{rng.choice('abé')}x.{rng.randint(1, 99)}@mail{rng.randint(1, 9)}.example.com",
        lambda: ".".join(str(rng.randint(0, 300)) for _ in range(rng.choice([3, 4, 4, 4, 5]))),
        card,
        lambda: "".join(rng.choices("0123456789", k=rng.choice([1, 4, 12, 16, 19, 24]))),
        lambda: f"+1 ({rng.randint(100, 999)}) 555-{rng.randint(1000, 9999)}",
        lambda: rng.choice(["a@b", "a@b.c_q@d.e", "a@b.c.@d.e", "12 -34", "1 2 3--4", "+1", "漢字", "𝒳", "x@y.z+1 2-3 4(5)"]),
        lambda: "".join(rng.choices("01 -.+@ab()", k=30)),
    ]
    rows = []
    for i in range(500):
        words = [rng.choice(bits)() if rng.random() < 0.3 else rng.choice(["la", "é", "the\n", "or,"]) for _ in range(rng.choice([0, 3, 20, 60]))]
        rows.append((i, rng.choice([" ", " ", ""]).join(words)))
    rows += [(600, None), (601, ""), (602, "7" * 50_000), (603, "a" * 50_000 + "@"), (604, "x@y.zz 12 " * 3_000), (604, "again a@b.cc")]
    rows += [(605, "1-" * 30_000), (606, "a@b." * 20_000), (607, "+1 2" * 20_000), (None, "id-less a@b.cc"), (602, "7" * 50_000)]
    return rows


@pytest.fixture(scope="module")
def private(spark):
    rows = spark.createDataFrame([(*r, "x", 1) for r in private_rows()], "track_id long, lyrics_text string, kind string, label int")
    return {(r["track_id"], r["lyrics_text"]): r for r in rows.repartition(4).transform(with_text).collect()}


def with_text(rows):
    """Spans beside their texts: the text is part of the id."""
    keyed = rows.withColumn("track_id", F.struct("track_id", "lyrics_text"))
    return find_private_data(keyed).select("track_id.*", "base", "spans")


def test_base_spans(private):
    for i, text in private_rows():
        assert [tuple(s) for s in private[i, text]["base"]] == base_spans(text), (i, (text or "")[:80])


def test_spans_add_to_base(private):
    more = Counter()
    for row in private.values():
        order = [(s["start"], KINDS.index(s["kind"]), s["end"]) for s in row["spans"]]
        assert order == sorted(set(order)) and set(row["base"]) <= set(row["spans"])
        assert all(0 <= s["start"] < s["end"] <= len(row["lyrics_text"]) for s in row["spans"])
        more.update(s["kind"] for s in set(row["spans"]) - set(row["base"]))
    assert more  # some candidates that base patterns miss look like those they find


def test_numbers_in_dropped_runs_are_found(spark):
    rng = random.Random(1)
    rows = []
    for i in range(400):
        number = f"+1 ({rng.randint(100, 999)}) 555-{rng.randint(1000, 9999)}"
        other = ".".join(str(rng.randint(1, 255)) for _ in range(4))
        rows.append((i, f"la {number} le {other} year 1999, no {rng.randint(1000, 9999)}"))
    rows.append((1_000, "la +1 (555) 555-1234 10.20.30.40 le"))  # the base pattern takes both numbers and drops them
    rows.append((1_001, "nothing here but 12 words"))
    found = {r["track_id"]: r for r in find_private_data(spark.createDataFrame(rows, "track_id long, lyrics_text string")).collect()}
    assert [s["kind"] for s in found[1_000]["base"]] == ["ip"]
    assert ("phone", 3, 20) in {tuple(s) for s in found[1_000]["spans"]}
    assert found[1_001]["spans"] == []


def test_private_data_of_no_rows(empty):
    assert find_private_data(empty).count() == 0


def test_trees_learn_from_every_candidate(spark, monkeypatch):
    n, learned = 60_000, []
    digit = lambda k: (F.floor(F.col("id") / 32**k) % 32).cast("int")
    features = F.array(F.lit(3), *map(digit, range(4)))
    candidate = F.struct(
        F.lit(0).cast("long").alias("start"), F.lit(3).alias("kind"), F.lit(9).cast("long").alias("end"),
        (F.col("id") % 2).cast("int").alias("label"), features.alias("features"),
    )
    base = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    found = spark.range(n).select(F.col("id").alias("track_id"), base.alias("base"), F.array(candidate).alias("candidates"))

    def fit(counted, rounds):
        learned.append(counted.agg(F.sum("n")).first()[0])

    monkeypatch.setattr(private_data, "candidates", lambda tracks: found)
    monkeypatch.setattr(private_data, "fit", fit)
    assert find_private_data(found).count() == n
    assert learned == [found.filter(F.pmod(F.xxhash64("track_id"), F.lit(5)) != 0).count()]


def test_running_sums(spark):
    for n in (0, 1, 5, 256, 257, 1_000):
        values = list(range(n))
        row = spark.createDataFrame([(values,)], "v array<long>").select(private_data.running(F.col("v"), 16)).first()
        assert row[0] == np.cumsum(values).tolist()


def test_trees_learn_both_features(spark):
    rows = [([a, b, c], 10, 9 if a > 3 and b <= 1 else 1) for a in range(8) for b in range(4) for c in range(2)]
    table = spark.createDataFrame(rows, "features array<int>, n long, good long")
    model = fit(table, rounds=12)
    wrong = table.filter((model.margin(F.col("features")) > 0) != (F.col("good") > 5)).count()
    assert wrong == 0
    assert fit(table.withColumn("good", F.col("n")), rounds=2) is None
