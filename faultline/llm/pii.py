"""Personal data: regular expressions propose, checksums confirm, context words adjust the score. Column functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Code points before a match in which its context words count.
CONTEXT = 40
#: Spans of the added kinds count from this score; the base kinds always do.
LEAST_SCORE = 0.5


@dataclass(frozen=True)
class Kind:
    """A kind of personal data; needs: a cheap pattern without which there is no match; base: reported whatever its score."""

    name: str
    pattern: str
    needs: str
    score: float
    context: str
    raised: float = 0.15
    base: bool = True


#: In the order in which kinds that start together are listed. Quantifiers are possessive and starts anchored so that
#: a long run of characters is scanned once and never backtracked into; the matches are those of the plain patterns:
#: email [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+   ip [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
#: card [0-9]([\x20-]?[0-9])+   phone \+[0-9][\x20().0-9-]+[0-9]
KINDS = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.85, r"mail|contact|write to|address"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]", 0.6, r"\bip\b|host|server|address|login"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", "[0-9]{2}|[0-9][ -][0-9]", 0.75, r"card|visa|credit|debit|carte|karte|tarjeta"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", 0.6, r"call|phone|tel|fax|mobile|whatsapp"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])", "[A-Z]{2}[0-9]{2}", 0.8, r"iban|account|bank|konto|cuenta|compte", base=False),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "[0-9]{3}-[0-9]{2}-", 0.3, r"ssn|social security|sécurité sociale|seguridad social", 0.4, base=False),
)
_NONE = "array<struct<start:int,kind:int,end:int,value:string,score:double>>"


def luhn(digits: Column) -> Column:
    """Digits from the right, every second one doubled with its own digits added, sum to a multiple of ten."""
    n = F.length(digits)

    def add(total, i):
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        twice = F.when(i % 2 == 0, d * 2).otherwise(d)
        return total + F.when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def mod97(iban: Column) -> Column:
    """The first four characters moved to the end, letters read as 10 to 35: the number leaves 1 modulo 97."""
    moved = F.concat(F.substring(iban, 5, 64), F.substring(iban, 1, 4))

    def add(rest, c):
        v = F.ascii(c)
        return F.when(v >= 65, (rest * 100 + v - 55) % 97).otherwise((rest * 10 + v - 48) % 97)

    return F.aggregate(F.split(moved, ""), F.lit(0), lambda r, c: F.when(F.length(c) == 0, r).otherwise(add(r, c))) == 1


def confirmed(kind: Kind, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind.name == "ip":  # each part at most 255, leading zeros or not
        return value.rlike(r"^0*+(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])?(?:(?<=[0-9])\.0*+(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])?){3}(?<=[0-9])$")
    if kind.name == "card":
        return F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(F.lit(False))
    if kind.name == "phone":
        return F.length(digits).between(10, 15)
    if kind.name == "iban":
        plain = F.replace(value, F.lit(" "), F.lit(""))
        return F.when(F.length(plain).between(15, 34), mod97(plain)).otherwise(F.lit(False))
    return F.lit(True)


def _placed(kind: int, pieces: Column, matches: Column) -> Column:
    """Where each match lies, in code points: the text between matches and the matches add up to the text.

    near: the last CONTEXT code points so far, handed from match to match, so no match reads the text again.
    """
    k = KINDS[kind]
    last = lambda c: F.right(c, F.lit(CONTEXT))

    def step(acc, pair):
        start = acc["at"] + F.length(pair["piece"])
        end = start + F.length(pair["match"])
        near = last(F.concat(acc["near"], last(pair["piece"])))
        score = F.when(F.lower(near).rlike(k.context), F.lit(k.score + k.raised)).otherwise(F.lit(k.score))
        hit = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), pair["match"].alias("value"), score.alias("score"))
        good = confirmed(k, pair["match"]) & (F.lit(k.base) | (score >= LEAST_SCORE))
        found = F.when(good, F.concat(acc["found"], F.array(hit))).otherwise(acc["found"])
        return F.struct(end.alias("at"), last(F.concat(near, last(pair["match"]))).alias("near"), found.alias("found"))

    pairs = F.zip_with(F.slice(pieces, F.lit(1), F.size(matches)), matches, lambda p, m: F.struct(p.alias("piece"), m.alias("match")))
    empty = F.struct(F.lit(0).alias("at"), F.lit("").alias("near"), F.array().cast(_NONE).alias("found"))
    return F.when(F.size(matches) > 0, F.aggregate(pairs, empty, step)["found"]).otherwise(F.array().cast(_NONE))


def find_spans(df: DataFrame) -> DataFrame:
    """Columns row and text of the frame with spans: an array of all spans (start, kind number, end, value, score), by start, then kind.

    A null text has none. row: whatever the caller keeps, as one struct, so no name of its can clash with those here.
    """
    t, kinds = F.col("text"), range(len(KINDS))
    none = F.array().cast("array<string>")
    df = df.select("row", "text", *[F.when(t.rlike(k.needs), F.regexp_extract_all(t, F.lit(k.pattern), F.lit(0))).otherwise(none).alias(f"m{i}") for i, k in enumerate(KINDS)])
    df = df.select("*", *[F.when(F.size(f"m{i}") > 0, F.split(t, k.pattern, -1)).otherwise(none).alias(f"p{i}") for i, k in enumerate(KINDS)])
    found = [_placed(i, F.col(f"p{i}"), F.col(f"m{i}")) for i in kinds]
    return df.select("row", "text", F.array_sort(F.concat(*found)).alias("spans"))


def _named(kind: Column) -> Column:
    return F.element_at(F.array(*[F.lit(k.name) for k in KINDS]), kind + 1)


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", _named(s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def detect(docs: DataFrame) -> DataFrame:
    """One row per document: counts of the base kinds, digest of the base spans, all spans and their scores.

    Matches of a kind do not overlap, leftmost first; those of different kinds may. A null text is empty: counts 0,
    no spans and the digest of no bytes. Repeated rows get equal results, extra columns are ignored, nothing is
    shuffled; a very long text stays one row.
    """
    found = find_spans(docs.select(F.struct(F.col("doc_id").cast("long").alias("doc_id")).alias("row"), F.coalesce(F.col("text"), F.lit("")).alias("text")))
    base = [i for i, k in enumerate(KINDS) if k.base]
    own = F.filter("spans", lambda s: s["kind"].isin(base))
    of_kind = lambda i: F.size(F.filter("spans", lambda s: s["kind"] == i))
    counts = [of_kind(i).cast("long").alias(f"n_{KINDS[i].name}") for i in base]
    return found.select(
        "row.doc_id",
        *counts,
        F.sha2(_listed(own).cast("binary"), 256).alias("base_sha256"),
        _listed(F.col("spans")).alias("spans"),
        F.array_join(F.transform("spans", lambda s: F.format_number(s["score"], 2)), ",").alias("scores"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """The documents with each span of personal data replaced by its kind in brackets; overlapping spans become one.

    All columns stay, whatever their names; n_chars, if there is one, is that of the new text. Null texts stay null.
    """
    text = F.col("text")

    def step(acc, s):
        fresh = s["start"] >= acc["at"]
        gap = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(fresh, F.concat(acc["out"], gap, F.lit("["), F.upper(_named(s["kind"])), F.lit("]"))).otherwise(acc["out"]).alias("out"),
        )

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    whole = F.aggregate(F.col("spans"), start, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    rest = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    kept = F.struct(*rest) if rest else F.struct(F.lit(None).cast("string").alias("none"))
    marked = find_spans(docs.select(kept.alias("row"), "text")).select("row", F.when(F.size("spans") > 0, whole).otherwise(text).alias("text"))
    new = {"text": F.col("text"), "n_chars": F.length("text")}
    return marked.select(*[new[c].cast(docs.schema[c].dataType).alias(c) if c in new else F.col(f"row.`{c}`") for c in docs.columns])
