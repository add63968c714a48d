"""Personal data in lyrics: base patterns, looser candidates, and boosted trees that choose among these."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .boosting import Boosted, fit
from .store import written

KINDS = ["email", "ip", "card", "phone"]  # fixed values: the order of kinds
EMAIL, IP, CARD, PHONE = range(4)
LOCAL = "[A-Za-z0-9._%+-]"
AT, DOT = r"(?:[@＠]| ?[(\[]at[)\]] ?)", r"(?:\.| ?[(\[]dot[)\]] ?)"
WORD = r"[\p{L}\p{N}-]"

# The base patterns. Repeats are possessive and a match begins where a run begins, so that long runs cost
# time in proportion; matches are those of the plain patterns, but for cards, whose runs of 12 to 19 digits alone match.
BASE = {
    EMAIL: rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    IP: r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    CARD: r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,18}+(?![ -]?[0-9])",
    PHONE: r"\+[0-9][ ().0-9-]+[0-9]",
}
OCTETS = r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})){3}$"

#: Generators of candidates: kind and pattern. They overlap each other and the base patterns.
GENERATORS = [
    (EMAIL, rf"(?i)(?<![\p{{L}}\p{{N}}._%+-])[\p{{L}}\p{{N}}._%+-]++{AT}{WORD}++(?:{DOT}{WORD}++)++"),
    (IP, r"(?<![0-9])[0-9]{1,3}(?:(?:\.|\[\.\]|\(\.\))[0-9]{1,3}){3}(?![0-9])"),
    (CARD, r"(?<![0-9])[0-9]{12,19}(?![0-9])"),
    (CARD, r"(?<![0-9])[0-9]{4}(?:[ ._/-][0-9]{4}){2}[ ._/-][0-9]{1,7}(?![0-9])"),
    (CARD, r"(?<![0-9])[0-9]{4}[ ._/-][0-9]{6}[ ._/-][0-9]{5}(?![0-9])"),
    (PHONE, r"(?<![0-9])\(?[0-9]{2,4}\)?[ ./-]?[0-9]{3,4}[ ./-][0-9]{3,4}(?![0-9])"),
    (PHONE, r"(?:\+|＋|(?<![0-9])00) ?[1-9][0-9]{0,2}[ .-]?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])"),
]
CONTEXT = 24  # characters before and after a candidate that are looked at, up to the generator's next match

#: Words before a candidate that speak for its kind, and those that speak against any.
CUES = {
    EMAIL: r"(?i)mail|contact|write|kontakt",
    IP: r"(?i)\bip\b|host|server|addr|login",
    CARD: r"(?i)card|carte|karte|tarjeta|visa|credit|pay",
    PHONE: r"(?i)tel|phone|call|fax|mobil|whatsapp|\+[0-9]{0,3} ?$",
}
OTHER_CUES = r"(?i)version|release|token|secret|key|isbn|order|invoice|serial|[=\"#]\s*$|\bv\.?\s*$"


def running(values: Column, block: int = 256) -> Column:
    """Sums of an array of longs up to each element, block by block, so that long arrays are not copied per element."""
    def sums(xs: Column) -> Column:
        start = F.array(F.lit(0).cast("long"))
        return F.aggregate(xs, start, lambda done, x: F.concat(done, F.array(F.element_at(done, -1) + x)))

    n = F.size(values)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / block).cast("int")), lambda k: F.slice(values, k * block + 1, block))
    totals = sums(F.transform(blocks, lambda b: F.aggregate(b, F.lit(0).cast("long"), lambda a, x: a + x)))
    own = F.zip_with(
        blocks,
        F.slice(totals, F.lit(1), F.size(blocks)),
        lambda b, t: F.transform(F.slice(sums(b), F.lit(2), F.size(b)), lambda s: s + t),
    )
    return F.when(n > 0, F.flatten(own)).otherwise(F.array().cast("array<bigint>"))


def matched(texts: DataFrame, patterns: list[str]) -> DataFrame:
    """Adds for each pattern `m<i>`: its matches in lyrics_text, leftmost and not overlapping.

    A match has start and end in characters, its text, and the characters before and after it up to the next match.
    """
    none = F.array().cast("array<string>")
    text = F.col("lyrics_text")
    for i, pattern in enumerate(patterns):
        sign = "@|(?i)[(\\[]at[)\\]]|＠" if "@" in pattern else "[0-9]"
        fits = text.rlike(sign) & text.rlike(pattern)
        texts = texts.withColumns(
            {
                f"gaps{i}": F.when(fits, F.split(text, pattern, -1)).otherwise(none),
                f"found{i}": F.when(fits, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none),
            }
        )
    for i in range(len(patterns)):
        lengths = F.zip_with(
            F.slice(f"gaps{i}", 1, F.size(f"found{i}")), f"found{i}", lambda g, m: (F.length(g) + F.length(m)).cast("long")
        )
        texts = texts.withColumn(f"ends{i}", running(lengths))
    for i in range(len(patterns)):
        match = _match(F.col(f"gaps{i}"), F.col(f"found{i}"))
        texts = texts.withColumn(f"m{i}", F.transform(f"ends{i}", match)).drop(f"gaps{i}", f"found{i}", f"ends{i}")
    return texts


def _match(gaps: Column, found: Column):
    def one(end: Column, k: Column) -> Column:
        match = F.get(found, k)
        return F.struct(
            (end - F.length(match)).alias("start"),
            end.alias("end"),
            match.alias("match"),
            F.right(F.get(gaps, k), F.lit(CONTEXT)).alias("before"),
            F.left(F.get(gaps, k + 1), F.lit(CONTEXT)).alias("after"),
        )

    return one


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits has a Luhn check digit."""
    def step(total: Column, i: Column) -> Column:
        digit = F.substr(number, F.length(number) - i + 1, F.lit(1)).cast("int")
        twice = F.when(digit > 4, 2 * digit - 9).otherwise(2 * digit)
        return total + F.when(i % 2 == 0, twice).otherwise(digit)

    places = F.sequence(F.lit(1), F.length(number))
    return F.when(F.length(number) == 0, False).otherwise(F.aggregate(places, F.lit(0), step) % 10 == 0)


def passes(kind: int, match: Column) -> Column:
    """Whether a match of the kind's base pattern is one."""
    n = F.length(digits(match))
    if kind == IP:
        return match.rlike(OCTETS)
    if kind == CARD:
        return luhn(digits(match))
    return n.between(9, 15) if kind == PHONE else F.lit(True)


def accepted(kind: int, c: Column) -> Column:
    """Whether the base rules, too, find the place of a candidate: the label that the trees learn."""
    match, before, after = c["match"], c["before"], c["after"]
    if kind == EMAIL:
        return match.rlike(f"^{BASE[EMAIL]}$") & ~before.rlike(f"{LOCAL}$")
    if kind == IP:
        return match.rlike(OCTETS) & ~before.rlike(r"[0-9]\.$")
    if kind == CARD:
        alone = ~before.rlike("[0-9][ -]?$") & ~after.rlike("^[ -]?[0-9]")
        return alone & match.rlike("^[0-9](?:[ -]?[0-9])++$") & luhn(digits(match))
    run = F.concat(F.regexp_extract(before, r"\+[ ().0-9-]*$", 0), match, F.regexp_extract(after, r"^[ ().0-9-]*", 0))
    return run.rlike(r"^\+[0-9]") & F.length(digits(run)).between(9, 15)


def char_class(char: Column) -> Column:
    """0 none, 1 blank, 2 letter, 3 digit, 4 mark of prose, 5 other."""
    return (
        F.when(char == "", 0)
        .when(char.rlike(r"^\s"), 1)
        .when(char.rlike(r"^\p{L}"), 2)
        .when(char.rlike(r"^\p{N}"), 3)
        .when(char.rlike(r"""^[.,;:!?'"()\[\]]"""), 4)
        .otherwise(5)
    )


def features(kind: int, c: Column) -> Column:
    """Format and context of a candidate in small whole numbers. What marks base forms (a plus, an @) is left out."""
    match, before, after = c["match"], c["before"], c["after"]
    number = digits(match)
    groups = F.filter(F.split(match, "[^0-9]+", -1), lambda g: g != "")
    sizes = F.transform(groups, F.length)
    large = F.filter(groups, lambda g: (F.length(g) > 3) | (F.lpad(F.right(g, F.lit(3)), 3, "0") > "255"))
    last = F.length(F.regexp_extract(match, r"[\p{L}]+$", 0))
    values = [
        F.lit(kind),
        F.length(number),
        (luhn(number) if kind == CARD else F.lit(False)).cast("int"),
        F.length(F.regexp_replace(match, r"[\p{L}\p{N}]", "")),
        F.floor(F.length(match) / 2),
        F.coalesce(F.array_max(sizes), F.lit(0)),
        F.coalesce(F.array_min(sizes), F.lit(0)),
        F.size(groups),
        char_class(F.right(before, F.lit(1))),
        char_class(F.left(after, F.lit(1))),
        F.coalesce(F.left(number, F.lit(1)).try_cast("int"), F.lit(10)),
        F.size(large) if kind == IP else F.lit(0),
        last,
        before.rlike(CUES[kind]).cast("int"),
        before.rlike(OTHER_CUES).cast("int"),
    ]
    return F.array(*(F.least(v, F.lit(31)).cast("int") for v in values))


def candidates(tracks: DataFrame) -> DataFrame:
    """track_id, base (start, kind, end) and candidates (start, kind, end, label, features): one pass over the texts."""
    patterns = [*BASE.items(), *GENERATORS]
    rows = tracks.select("track_id", F.coalesce("lyrics_text", F.lit("")).alias("lyrics_text"))
    found = matched(rows, [p for _, p in patterns]).drop("lyrics_text")
    base = [F.transform(F.filter(f"m{i}", _passing(kind)), _span(kind)) for i, kind in enumerate(BASE)]
    loose = [F.transform(f"m{i}", _candidate(kind)) for i, (kind, _) in enumerate(GENERATORS, len(BASE))]
    return found.select("track_id", F.array_sort(F.concat(*base)).alias("base"), F.concat(*loose).alias("candidates"))


def _passing(kind: int):
    return lambda c: passes(kind, c["match"])


def _span(kind: int):
    return lambda c: F.struct(c["start"].alias("start"), F.lit(kind).alias("kind"), c["end"].alias("end"))


def _candidate(kind: int):
    return lambda c: F.struct(
        c["start"].alias("start"),
        F.lit(kind).alias("kind"),
        c["end"].alias("end"),
        accepted(kind, c).cast("int").alias("label"),
        features(kind, c).alias("features"),
    )


def cells(found: DataFrame) -> DataFrame:
    """held, features, n, good: all candidates counted by their features."""
    each = found.select(F.xxhash64("track_id").alias("hash"), F.explode("candidates").alias("c"))
    held = (F.pmod("hash", F.lit(5)) == 0).alias("held")
    return each.groupBy(held, F.col("c.features").alias("features")).agg(
        F.count("*").alias("n"), F.sum("c.label").alias("good")
    )


def thresholds(model: Boosted, held: DataFrame, precision: float) -> dict[int, float]:
    """For each kind the smallest margin from which on so many of the held-out candidates are good; kinds without are left out.

    Margins are taken in steps of a tenth; one good and one bad candidate are added to each count.
    """
    step = F.floor(model.margin(F.col("features")) * 10).alias("step")
    kind = F.get("features", F.lit(0)).alias("kind")
    rows = held.groupBy(kind, step).agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    chosen: dict[int, float] = {}
    sums: dict[int, list[int]] = {}
    for kind, step, n, good in sorted(rows.collect(), key=lambda r: -r["step"]):  # a row per tenth of a margin
        total = sums.setdefault(kind, [0, 0])
        total[0] += n
        total[1] += good
        if total[1] and (total[1] + 1) / (total[0] + 2) >= precision:
            chosen[kind] = step / 10
    return chosen


def find_private_data(tracks: DataFrame, precision: float = 0.9, rounds: int = 8) -> DataFrame:
    """Places of personal data in each track's lyrics: e-mail and IP addresses, card and phone numbers.

    tracks: track_id, lyrics_text. Returns track_id, base and spans: arrays of kind, start, end in characters (end
    exclusive) by start, then kind in the order of KINDS. `base` has the matches of the base patterns that pass their
    checks (octets up to 255; 12 to 19 digits with a Luhn digit; 9 to 15 digits); `spans` has these and more.

    Looser generators propose candidates, which may overlap: local numbers, other separators, written-out `at` and
    `dot`, numbers inside runs that a base pattern takes whole and drops. Boosted trees learn from all candidates, by
    format and context, which of them the base rules find; features that only mark base forms are left out, so other
    forms are judged by what they share with them. Candidates of a fifth of the tracks calibrate a margin for each
    kind: the smallest at which a share of `precision` is found by the base rules, too. Candidates from it on join the
    spans, unless the base rules find them. Where nothing can be learned (no candidates, one label) base spans stand alone.

    The trees are fitted and the margins calibrated on the counts of all distinct feature rows of the whole table, a
    table that Spark aggregates; the driver sees histograms only. Texts are read once, and nothing is shuffled but such
    counts. Null and empty lyrics have no spans; equal texts get equal spans; rows repeat as they come; very long texts take time in proportion, their matches
    lie in one row; an empty table gives an empty result; other columns are ignored.
    """
    found = written(candidates(tracks))
    counted = written(cells(found))
    model = fit(counted.filter(~F.col("held")), rounds)
    least = thresholds(model, counted.filter("held"), precision) if model else {}

    def chosen(c: Column) -> Column:
        fits = F.lit(False)
        margin = model.margin(c["features"])
        for kind, value in least.items():
            fits = fits | ((c["kind"] == kind) & (margin >= value))
        return (c["label"] == 0) & fits

    def span(c: Column) -> Column:
        return F.struct(*(c[name].alias(name) for name in ("start", "kind", "end")))

    more = F.transform(F.filter("candidates", chosen), span) if least else F.filter("base", lambda c: F.lit(False))
    every = found.select("track_id", "base", F.array_sort(F.concat("base", more)).alias("every"))
    once = F.filter("every", lambda s, i: (i == 0) | (s != F.get("every", i - 1)))
    kinds = F.array(*map(F.lit, KINDS))

    def named(spans: Column) -> Column:
        return F.transform(spans, lambda s: F.struct(F.get(kinds, s["kind"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))

    return every.select("track_id", named(F.col("base")).alias("base"), named(once).alias("spans"))
