"""Personal data in texts: patterns propose spans, checksums confirm them, words nearby move their score.

Everything is a DataFrame expression on one row, so nothing is shuffled and a lost executor costs its tasks alone.
Offsets are sums of the lengths of what lies between the matches, so a text is walked a fixed number of times however
many spans it has.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from samplery.llm.common import col, free_prefix

#: Code points of the gaps around a match in which context words count.
BEFORE, AFTER = 40, 20
#: Score (in hundredths) from which a kind that is not always kept is reported, and what a word for or against it moves.
THRESHOLD, FOR, AGAINST = 60, 40, -30
#: Elements that a running sum takes at a time.
BLOCK = 256
SPANS = "array<struct<kind:string,start:bigint,end:bigint,score:int,value:string>>"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Total length of an IBAN by country, as the IBAN registry has them.
IBAN_LENGTHS = (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 "
    "GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 "
    "PS29 PT25 QA29 RO24 RS22 SA24 SC31 SE24 SI19 SK24 SM27 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20"
)


@dataclass(frozen=True)
class Match:
    """A proposed span: the matched string and the gaps to its neighbours of the same kind."""

    value: Column
    before: Column
    after: Column


@dataclass(frozen=True)
class Kind:
    """One kind of personal data.

    ``pattern`` proposes; ``confirm`` keeps or drops a match; ``length`` gives the confirmed length where it is less than
    the match's; ``prior`` is the score without context; ``words`` and ``against`` are lower-case context words;
    ``always`` reports every confirmed match whatever its score; ``holds`` is a string without which nothing matches.
    """

    name: str
    pattern: str
    confirm: Callable[[Match], Column]
    prior: int
    words: str
    against: str = ""
    always: bool = True
    holds: str = ""
    length: Callable[[Match], Column] | None = None


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _ip(m: Match) -> Column:
    return m.value.rlike(r"^0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(\.0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$")


def _card(m: Match) -> Column:
    digits = _digits(m.value)
    return F.when(F.length(digits).between(13, 19), F.call_function("luhn_check", digits)).otherwise(F.lit(False))


def mod97(code: Column) -> Column:
    """Remainder by 97 of an upper-case alphanumeric string read as ISO 7064 does, letters being 10 to 35."""
    return F.aggregate(
        F.split(code, ""), F.lit(0),
        lambda rest, ch: (rest * F.when(ch.between("0", "9"), 10).otherwise(100) + F.when(ch.between("0", "9"), F.ascii(ch) - 48).otherwise(F.ascii(ch) - 55)) % 97,
    )


def _iban_length(m: Match) -> Column:
    """Length in the text of the IBAN that a match begins with: compact, or in groups of four; 0 if it is neither."""
    own = F.substring(m.value, 1, 2)
    n = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for c in IBAN_LENGTHS.split() for x in (c[:2], int(c[2:]))]), own), F.lit(0))
    grouped = n + F.floor((n - 1) / 4).cast("int")
    compact = lambda size: F.translate(F.left(m.value, size), " ", "")
    return F.when(n == 0, 0).when(F.length(compact(n)) == n, n).when(F.length(compact(grouped)) == n, grouped).otherwise(0)


def _iban(m: Match) -> Column:
    size = _iban_length(m)
    code = F.translate(F.left(m.value, size), " ", "")
    alone = ~F.right(m.before, F.lit(1)).rlike("[A-Za-z0-9]") & (F.substring(m.value, size + 1, F.lit(1)).isin("", " ")) & ~((size == F.length(m.value)) & F.left(m.after, F.lit(1)).rlike("[A-Za-z0-9]"))
    return F.when(size == 0, F.lit(False)).otherwise(alone & (mod97(F.concat(F.substring(code, F.lit(5), F.length(code)), F.left(code, F.lit(4)))) == 1))


def _apart(m: Match, touching: str) -> Column:
    """No digit follows, and what stands before does not go on into the match."""
    return ~F.right(m.before, F.lit(4)).rlike(touching) & ~F.left(m.after, F.lit(1)).rlike("[0-9]")


def _local_phone(m: Match) -> Column:
    return _apart(m, r"[0-9+][ .(-]*$")


def _national_id(m: Match) -> Column:
    return _apart(m, "[0-9-]$") & ~F.left(m.after, F.lit(1)).isin("-") & ~m.value.rlike("^(000|666|9)|-00-|0000$")


#: In the order in which spans are listed. The first four are always reported once confirmed; quantifiers are possessive
#: and starts are bound to the start of a run, which changes no match but keeps long runs of one class linear.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda m: F.lit(True), 80, "e-?mail|mail|contact|kontakt|correo|courriel", holds="@"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", _ip, 60, "ip|address|host|server|client|login", "version|release|section"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", _card, 70, "card|visa|mastercard|amex|credit|debit|payment|karte|tarjeta|carte", "order|invoice|isbn|tracking|serial"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: F.length(_digits(m.value)).between(9, 15), 70, "phone|telephone|tel|mobile|cell|call|fax|telefon|handy", "order|invoice|serial", holds="+"),
    Kind("iban", r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9])++", _iban, 75, "iban|account|bank|konto|cuenta|compte", always=False, length=_iban_length),
    Kind("local_phone", r"\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}", _local_phone, 30, "phone|telephone|tel|mobile|cell|call|fax|telefon|handy", "order|invoice|serial", always=False),
    Kind("national_id", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", _national_id, 35, "ssn|social security|tax id|tin|national id", "order|invoice|serial|part", always=False),
)


def _word(words: str) -> str:
    return f"(^|[^a-z])({words})($|[^a-z])"


def _score(kind: Kind, m: Match) -> Column:
    near = F.translate(F.concat(F.right(m.before, F.lit(BEFORE)), F.lit(" # "), F.left(m.after, F.lit(AFTER))), UPPER, LOWER)
    score = F.lit(kind.prior) + F.when(near.rlike(_word(kind.words)), FOR).otherwise(0)
    if kind.against:
        score = score + F.when(near.rlike(_word(kind.against)), AGAINST).otherwise(0)
    return F.least(score, F.lit(100))


def _fold(values: Column) -> Column:
    """Total of an array of longs and the sum before each element."""
    start = F.struct(F.lit(0).cast("long").alias("total"), F.array().cast("array<bigint>").alias("sums"))
    return F.aggregate(values, start, lambda s, x: F.struct((s["total"] + x).alias("total"), F.concat(s["sums"], F.array(s["total"])).alias("sums")))


def _blocks(values: Column) -> Column:
    """``_fold`` of each ``BLOCK`` elements of a filled array: appending to one long array would copy it each time."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int")), lambda k: _fold(F.slice(values, k * BLOCK + 1, BLOCK)))


def _sums_before(blocks: Column) -> Column:
    """Sum of all elements before each one, of ``_blocks``."""
    return F.flatten(F.zip_with(blocks, _fold(F.transform(blocks, lambda b: b["total"]))["sums"], lambda b, o: F.transform(b["sums"], lambda s: s + o)))


def _matches(df: DataFrame, text: Column, kinds: Sequence[Kind], p: str) -> DataFrame:
    """Adds ``{p}m_kind`` (matches), ``{p}g_kind`` (gaps between them) for each kind; no gaps where nothing matches."""
    found = {}
    for k in kinds:
        all_of = F.regexp_extract_all(text, F.lit(k.pattern), F.lit(0))
        found[f"{p}m_{k.name}"] = F.when(F.contains(text, F.lit(k.holds)), all_of).otherwise(F.array().cast("array<string>")) if k.holds else all_of
    df = df.withColumns(found)
    return df.withColumns({f"{p}g_{k.name}": F.when(F.size(F.col(f"{p}m_{k.name}")) > 0, F.split(text, k.pattern, -1)) for k in kinds})


def _judged(kind: Kind, value: Column, i: Column, gaps: Column) -> tuple[Column, Column, Column]:
    """Whether a match stands, its length and its score."""
    m = Match(value, F.get(gaps, i), F.get(gaps, i + 1))
    score = _score(kind, m)
    stands = kind.confirm(m) if kind.always else kind.confirm(m) & (score >= THRESHOLD)
    return stands, kind.length(m) if kind.length else F.length(value), score


def _lengths(kind: Kind, p: str) -> Column:
    """Length of each match together with the gap before it."""
    gaps = F.col(f"{p}g_{kind.name}")
    return F.transform(F.col(f"{p}m_{kind.name}"), lambda m, i: (F.length(m) + F.length(F.get(gaps, i))).cast("long"))


def _spans(kind: Kind, p: str) -> Column:
    """The kind's spans that stand."""
    found, gaps, before = (F.col(f"{p}{x}_{kind.name}") for x in "mgs")

    def span(m: Column, i: Column) -> Column:
        stands, length, score = _judged(kind, m, i, gaps)
        start = F.get(before, i) + F.length(F.get(gaps, i))
        return F.when(stands, F.struct(F.lit(kind.name).alias("kind"), start.alias("start"), (start + length).alias("end"), score.cast("int").alias("score"), F.left(m, length).alias("value")))

    return F.when(F.size(found) > 0, F.filter(F.transform(found, span), lambda s: s.isNotNull())).otherwise(F.array()).cast(SPANS)


def _replaced(kind: Kind, text: Column, p: str) -> Column:
    """The text with the kind's spans replaced."""
    found, gaps = (F.col(f"{p}{x}_{kind.name}") for x in "mg")

    def piece(m: Column, i: Column) -> Column:
        stands, length, _ = _judged(kind, m, i, gaps)
        mark = F.concat(F.lit(f"<{kind.name.upper()}>"), F.substring(m, length + 1, F.length(m)))
        return F.concat(F.get(gaps, i), F.when(stands, mark).otherwise(m))

    return F.when(F.size(found) > 0, F.concat(F.array_join(F.transform(found, piece), ""), F.element_at(gaps, -1))).otherwise(text)


def find(documents: DataFrame, text: str = "text", into: str = "__pii", kinds: Sequence[Kind] = KINDS) -> DataFrame:
    """Adds ``into``: the personal data in each text, as an array of (kind, start, end, score, value) by kind as listed, then start.

    Offsets count code points, the end is exclusive. Matches of one kind are leftmost and do not overlap; a match that
    fails its check is dropped and not tried again further on. Kinds are found on their own, so spans of unlike kinds
    may overlap. Context is at most 40 code points before and 20 after a match, up to its neighbours of the same kind.
    Null and empty texts have none; every row stays, repeated ones too; a column named ``into`` is replaced; other
    columns may have any name.
    """
    p = free_prefix(documents)
    held = _matches(documents.withColumn(f"{p}t", F.coalesce(col(text), F.lit(""))), F.col(f"{p}t"), kinds, p)
    for step, made in (("l", lambda k: _lengths(k, p)), ("b", lambda k: _blocks(F.col(f"{p}l_{k.name}"))), ("s", lambda k: _sums_before(F.col(f"{p}b_{k.name}")))):
        # each in a projection of its own: within a lambda function, an expression is computed for each element
        held = held.withColumns({f"{p}{step}_{k.name}": F.when(F.size(F.col(f"{p}m_{k.name}")) > 0, made(k)) for k in kinds})
    held = held.withColumn(f"{p}all", F.concat(*[_spans(k, p) for k in kinds]))
    kept = [col(c) for c in documents.columns if c != into]
    return held.select(*kept, F.col(f"{p}all").alias(into))


def redact(documents: DataFrame, text: str = "text", kinds: Sequence[Kind] = KINDS) -> DataFrame:
    """Replaces personal data in ``text`` by the upper-case name of its kind in angle brackets, one kind after the other as listed.

    A later kind does not see what an earlier one has replaced. Nulls stay null, and all columns and rows stay.
    """
    p, out = free_prefix(documents), documents
    for k in kinds:
        held = _matches(out, F.coalesce(col(text), F.lit("")), [k], p)
        changed = _replaced(k, col(text), p)
        out = held.select(*[changed.alias(c) if c == text else col(c) for c in documents.columns])
    return out


def of_kinds(spans: Column, *kinds: str) -> Column:
    """The spans of these kinds only."""
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
