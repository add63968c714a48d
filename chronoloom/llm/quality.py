"""Quality rules for lyrics: distance of their histograms from their language's."""

from __future__ import annotations

import unicodedata
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .batches import sliced
from .store import written
from .words import PerWord, WordBook

# Frequent words of each language.
COMMON_WORDS = {
    "en": "the of and to in a is that it for was on are with as be at this from have or by not but".split(),
    "fr": "de la le et les des en un une que qui dans du est pour par au sur pas il ne plus avec ce".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an".split(),
    "es": "de la que el en y a los del se las por un para con no una su al lo como más pero sus".split(),
}
SYMBOLS = "#*$%&|<>"  # fixed values
MARKS = ".,;:?!'\"()-"  # fixed values: punctuation of prose
BLANKS = "\t\n\v\f\r "  # fixed values: what separates words
CLASSES = ["lower", "upper", "digit", "mark", "symbol", "letter", "blank", "other"]
LOWER, UPPER, DIGIT, MARK, SYMBOL, LETTER, BLANK, REST = range(8)
WINDOW = 5


def class_table() -> np.ndarray:
    """Class of each code point up to U+FFFF; all above are `other`."""
    table = np.full(0x10001, REST, np.uint8)
    kinds = {"Ll": LOWER, "Lu": UPPER, "Lt": UPPER, "Nd": DIGIT, "Lo": LETTER, "Lm": LETTER}
    for point in range(0x10000):
        table[point] = kinds.get(unicodedata.category(chr(point)), REST)
    for chars, kind in ((MARKS, MARK), (SYMBOLS, SYMBOL), (BLANKS, BLANK)):
        table[[ord(c) for c in chars]] = kind
    return table


def repeated_words(codes: np.ndarray, window: int = WINDOW) -> int:
    """Words that lie in a window found twice or more."""
    n = len(codes) - window + 1
    if n < 2:
        return 0
    key = np.zeros(n, np.uint64)
    for i in range(window):
        key = key * np.uint64(0x9E3779B97F4A7C15) + codes[i : i + n].astype(np.uint64) + np.uint64(1)
        key ^= key >> np.uint64(29)
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    a, b = order[:-1][same], order[1:][same]
    if not len(a):
        return 0
    steps = np.arange(window)
    if (codes[a[:, None] + steps] != codes[b[:, None] + steps]).any():  # two windows share a hash
        seen: dict[tuple, list[int]] = {}
        for i in range(n):
            seen.setdefault(tuple(codes[i : i + window]), []).append(i)
        a = b = np.array([i for at in seen.values() if len(at) > 1 for i in at], np.int64)
    edge = np.zeros(len(codes) + 1, np.int64)
    starts = np.unique(np.concatenate([a, b]))
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return int((np.cumsum(edge) > 0).sum())


def repeated_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in text.split("\n") if line.strip(BLANKS)]
    return len(lines) - len(set(lines))


#: First words of letter names that belong to one writing.
EAST = {"HIRAGANA", "KATAKANA", "KATAKANA-HIRAGANA", "CJK", "BOPOMOFO", "HALFWIDTH", "IDEOGRAPHIC"}


@lru_cache(maxsize=1)
def script_table() -> tuple[np.ndarray, list[str]]:
    """Script of each letter up to U+FFFF as a number (0: no letter), by the first word of its name; the scripts' names."""
    names = [""]
    table = np.zeros(0x10001, np.uint16)
    for point in range(0x10000):
        char = chr(point)
        if unicodedata.category(char)[0] == "L":
            name = unicodedata.name(char, "").partition(" ")[0]
            name = "EAST" if name in EAST else name
            if name not in names:
                names.append(name)
            table[point] = names.index(name)
    return table, names


def common_index(languages: dict[str, list[str]]) -> dict[bytes, int]:
    names = sorted({w for words in languages.values() for w in words})
    return {w.encode(): i for i, w in enumerate(names)}


def plain_word(word: bytes) -> str:
    """A word as the lists of frequent words have it."""
    return word.decode().lower().strip(MARKS)


def learned_words(rows: DataFrame, known: list[str], least: int, most: int, most_words: int) -> dict[str, list[str]]:
    """Frequent words of the languages of the table that have no list, from all their tracks.

    Languages of at least `least` tracks, and of these the `most` with the most; words are counted by task before they meet.
    """
    other = rows.filter(F.col("language").isNotNull() & ~F.col("language").isin(known))
    sizes = other.groupBy("language").count().filter(F.col("count") >= least).orderBy(F.desc("count"), "language").limit(most)
    found = sorted(r["language"] for r in sizes.collect())
    if not found:
        return {}

    def count(batches):
        for batch in sliced(batches):
            counts: Counter = Counter()
            for language, text in zip(*(c.to_pylist() for c in batch.columns)):
                counts.update((language, w) for w in map(plain_word, text.encode().split()) if w)
            languages, words = zip(*counts) if counts else ((), ())
            columns = [pa.array(languages, pa.string()), pa.array(words, pa.string()), pa.array(counts.values(), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["language", "word", "n"])

    counted = other.filter(F.col("language").isin(found)).select("language", "lyrics_text")
    sums = counted.mapInArrow(count, "language string, word string, n long").groupBy("language", "word").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("language").orderBy(F.desc("n"), "word"))
    words: dict[str, list[str]] = {name: [] for name in found}
    for row in sums.withColumn("rank", rank).filter(F.col("rank") <= most_words).collect():  # most_words rows a language
        words[row["language"]].append(row["word"])
    return words


FIGURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def measured(tracks: DataFrame, languages: dict[str, list[str]], carried: list[str]) -> DataFrame:
    """Figures of each track: the base rules' counts, its script, and histograms of classes and common words as packed longs."""
    index = common_index(languages)

    def measure(batches):
        table, (scripts, _) = class_table(), script_table()
        book = WordBook()
        common_of = PerWord(book, lambda w: index.get(plain_word(w).encode(), len(index)))
        for batch in sliced(batches):
            book.trim()
            out = {n: [] for n in [*FIGURES, "script", "classes", "commons"]}
            texts = batch.column(2).to_pylist()
            coded = [book.codes(t.encode().split()) for t in texts]
            commons = common_of.table()
            for text, codes in zip(texts, coded):
                points = np.minimum(np.frombuffer(text.encode("utf-32-le"), np.uint32), 0x10000)
                classes = np.bincount(table[points], minlength=len(CLASSES))
                letters = np.bincount(scripts[points], minlength=2)[1:]
                out["n_words"].append(len(codes))
                out["word_chars"].append(len(points) - int(classes[BLANK]))
                out["n_symbols"].append(int(classes[SYMBOL]))
                out["n_dup_lines"].append(repeated_lines(text))
                out["n_repeat_words"].append(repeated_words(codes))
                out["script"].append(1 + int(letters.argmax()) if letters.any() else 0)
                out["classes"].append(classes.astype(np.int64).tobytes())
                out["commons"].append(np.bincount(commons[codes], minlength=len(index) + 1).astype(np.int64).tobytes())
            kinds = {"classes": pa.binary(), "commons": pa.binary()}
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(v, kinds.get(n, pa.int64())) for n, v in out.items()), *batch.columns[3:]],
                ["track_id", "language", *out, *carried],
            )

    kinds = {f.name: f.dataType.simpleString() for f in tracks.schema}
    return tracks.select("track_id", "language", "lyrics_text", *carried).mapInArrow(
        measure,
        f"track_id {kinds['track_id']}, language string, {', '.join(f'{f} long' for f in FIGURES)}, script long, "
        + ", ".join(["classes binary", "commons binary", *(f"{c} {kinds[c]}" for c in carried)]),
    )


def unpacked(column: pa.Array, width: int) -> np.ndarray:
    """Rows of packed longs."""
    return np.frombuffer(b"".join(column.to_pylist()), np.int64).reshape(-1, width)


def references(counts: DataFrame, languages: dict[str, list[str]]) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Script, class and common-word histogram of each language that has tracks with words, over all of these."""
    width = len(CLASSES) + len(common_index(languages)) + 1
    scripts = 1 << 32  # slots from here on count tracks by script

    def add(batches):
        for batch in sliced(batches):
            figures = np.hstack([unpacked(batch.column("classes"), len(CLASSES)), unpacked(batch.column("commons"), width - len(CLASSES))])
            names = np.array(batch.column("language").to_pylist(), object)
            script = batch.column("script").to_numpy()
            out: list[tuple[str, int, int]] = []
            for name in sorted(set(names)):
                own = names == name
                sums = figures[own].sum(0)
                out += [(name, int(i), int(sums[i])) for i in np.flatnonzero(sums)]
                out += [(name, scripts + i, int(n)) for i, n in enumerate(np.bincount(script[own])) if n and i]
            columns = list(zip(*out)) or [(), (), ()]
            kinds = (pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["language", "slot", "n"])

    known = counts.filter(F.col("language").isin(list(languages)) & (F.col("n_words") > 0))
    narrow = known.select("language", "script", "classes", "commons")
    sums = narrow.mapInArrow(add, "language string, slot long, n long").groupBy("language", "slot").agg(F.sum("n").alias("n"))
    found: dict[str, tuple[dict[int, int], np.ndarray]] = {}
    for name, slot, n in sums.collect():  # a row per language and class, common word or script
        tally, values = found.setdefault(name, ({}, np.zeros(width)))
        if slot >= scripts:
            tally[slot - scripts] = n
        else:
            values[slot] = n
    return [
        (max(tally, key=lambda i: (tally[i], -i), default=0), values[: len(CLASSES)], values[len(CLASSES) :])
        for _, (tally, values) in sorted(found.items())
    ]


def divergence(counts: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (0 to 1, base 2) of each row of counts from the reference."""
    p = counts / np.maximum(counts.sum(1, keepdims=True), 1)
    q = (reference / max(reference.sum(), 1))[None, :]
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0).sum(1)
        right = np.where(q > 0, q * np.log2(q / m), 0).sum(1)
    return np.sqrt(np.clip((left + right) / 2, 0, 1))


#: A track is rejected if it has the words and both distances are above: (words, class, common words).
GUARDS = [(20, 0.30, 0.0), (20, 0.13, 0.36), (100, 0.13, 0.28), (300, 0.14, 0.20)]


def distances(
    script: np.ndarray, classes: np.ndarray, commons: np.ndarray, known: list[tuple[int, np.ndarray, np.ndarray]]
) -> tuple[np.ndarray, np.ndarray]:
    """Class and word distance of each row from its nearest language: of those of its script, of all if it has no letters.

    NaN where no language has the row's script.
    """
    n = len(script)
    nearest = np.full((3, n), np.inf)  # sum, by class, by word
    for own, c, w in known:
        rows = np.flatnonzero((script == own) | (script == 0))
        by_class, by_word = divergence(classes[rows], c), divergence(commons[rows], w)
        closer = by_class + by_word < nearest[0, rows]
        nearest[:, rows[closer]] = np.array([by_class + by_word, by_class, by_word])[:, closer]
    return tuple(np.where(np.isfinite(nearest[0]), d, np.nan) for d in nearest[1:])


def judge_lyrics(
    tracks: DataFrame,
    languages: dict[str, list[str]] = COMMON_WORDS,
    guards: list[tuple[int, float, float]] = GUARDS,
    least_tracks: int = 20,
    most_languages: int = 100,
    most_words: int = 30,
    carried: str | None = None,
) -> DataFrame:
    """Whether each track's lyrics read like their language, by histogram distances.

    tracks: track_id, language, lyrics_text. languages: frequent words by language; other languages of the table with
    `least_tracks` tracks or more (at most `most_languages` of them, those with the most tracks) get the `most_words` most frequent words of all their tracks. The
    character classes and frequent words of a track are compared with those of every such language of its script, summed over all
    the language's tracks, by the Jensen-Shannon distance; the nearest language counts, whatever the track's own is. The
    script of a track is that of most of its letters (kana and Chinese characters are one), of a language that of most
    of its tracks. Lyrics in a script that no language has are not judged: for them base rules alone hold. Short
    lyrics say little, so each guard asks for a number of words. Before that, two base rules fail tracks of under 10
    words or with over 20 % of words in repeated five-word windows. Returns track_id, n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, base_failed, class_distance, word_distance (null if not judged), kept, and the column
    `carried` as it is, if one is named.

    Null lyrics count as empty and fail the base rules; lyrics without letters are held against all languages; unknown
    or null languages are judged but not learned from. Rows repeat as they come; an empty table gives an empty result;
    other columns are ignored. Texts are read once, by task, in slices bounded by bytes (a very long text is one of its
    own), and once more where a language without a list is learned; the references are one small row per language and
    class or word.
    """
    rest = ["_carried"] if carried else []
    rows = tracks.select(
        "track_id",
        "language",
        F.coalesce("lyrics_text", F.lit("")).alias("lyrics_text"),
        *(F.col(carried).alias(name) for name in rest),
    )
    languages = languages | learned_words(rows, list(languages), least_tracks, most_languages, most_words)
    counts = written(measured(rows, languages, rest))
    known = references(counts, languages)
    width = len(common_index(languages)) + 1

    def judge(batches):
        for batch in sliced(batches):
            words = batch.column("n_words").to_numpy()
            repeats = batch.column("n_repeat_words").to_numpy()
            failed = (words < 10) | (100 * repeats > 20 * words)
            by_class, by_word = distances(
                batch.column("script").to_numpy(),
                unpacked(batch.column("classes"), len(CLASSES)),
                unpacked(batch.column("commons"), width),
                known,
            )
            rejected = failed.copy()
            for least, far_class, far_word in guards:
                rejected |= (words >= least) & (by_class > far_class) & (by_word > far_word)  # not where a distance is NaN
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("track_id"),
                    *(batch.column(f) for f in FIGURES),
                    pa.array(failed),
                    *(pa.array(d, pa.float64(), mask=np.isnan(d)) for d in (by_class, by_word)),
                    pa.array(~rejected),
                    *(batch.column(name) for name in rest),
                ],
                ["track_id", *FIGURES, "base_failed", "class_distance", "word_distance", "kept", *rest],
            )

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    judged = counts.mapInArrow(
        judge,
        f"track_id {kinds['track_id']}, {', '.join(f'{f} long' for f in FIGURES)}, base_failed boolean, "
        + ", ".join(["class_distance double", "word_distance double", "kept boolean", *(f"{r} {kinds[r]}" for r in rest)]),
    )
    return judged.withColumnRenamed("_carried", carried) if carried else judged
