"""String rules of the data model as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Cells that mean true, and anomaly types that mean there is no anomaly.
TRUE_CELLS = ("1", "true", "yes", "y")
NOT_ANOMALOUS = ("", "good", "normal", "none", "unknown", "no_label", "unlabeled")
#: Endings of an entity name and the label they imply, tried in order, and the label of all other names.
SUFFIX_LABELS = (
    ("Object", "Object"),
    ("Defect", "Defect"),
    ("Pattern", "Pattern"),
    ("Morphology", "Morphology"),
    ("Location", "Location"),
    ("Cause", "CandidateCause"),
    ("Mechanism", "Mechanism"),
    ("Evidence", "EvidenceSource"),
    ("Fault", "Fault"),
    ("ProcessUnit", "ProcessUnit"),
    ("Unit", "ProcessUnit"),
    ("Variable", "Variable"),
    ("Anomaly", "Anomaly"),
)
OTHER_LABEL = "Concept"


def normalize(c: Column) -> Column:
    """Lower case, ASCII letters and digits only: the key under which mentions and terms meet."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")


def token(c: Column) -> Column:
    """Lower case, every run of other than letters and digits one underscore, none at the ends."""
    return F.btrim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "_"), F.lit("_"))


def text_or_null(c: Column) -> Column:
    t = F.trim(c)
    return F.when(t != "", t)


def text_list(c: Column, separators: str = "[|;,]") -> Column:
    """Parts between separators, trimmed, blank ones left out."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), separators), lambda x: F.trim(x)), lambda x: x != "")


def bool_cell(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c)).isin(*TRUE_CELLS), F.lit(False))


def float_cell(c: Column, default: float | None = 0.0) -> Column:
    return F.coalesce(F.nullif(F.trim(c), F.lit("")).try_cast("double"), F.lit(default))


def bad_float(c: Column) -> Column:
    """A cell that holds something, but no number."""
    t = F.nullif(F.trim(c), F.lit(""))
    return t.isNotNull() & t.try_cast("double").isNull()


def pascal(c: Column) -> Column:
    """Words with initial capitals, joined; Entity before a digit, and alone where nothing is left."""
    words = F.regexp_extract_all(c, F.lit("[A-Za-z0-9]+"), F.lit(0))
    joined = F.concat_ws("", F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 20))))
    return F.when(joined == "", F.lit("Entity")).when(joined.rlike("^[0-9]"), F.concat(F.lit("Entity"), joined)).otherwise(joined)


def label_of(c: Column) -> Column:
    out = F.lit(OTHER_LABEL)
    for ending, label in reversed(SUFFIX_LABELS):
        out = F.when(F.endswith(c, F.lit(ending)), F.lit(label)).otherwise(out)
    return out


def is_not_anomalous(c: Column) -> Column:
    return F.coalesce(token(c).isin(*NOT_ANOMALOUS), F.lit(True))


def fault_number(explicit: Column, text: Column) -> Column:
    """The explicit number, else the digits after `fault` in the text."""
    found = F.regexp_extract(F.lower(text), r"fault[_ -]?(\d+)", 1)
    return F.coalesce(explicit.cast("int"), F.nullif(found, F.lit("")).cast("int"))


def channel_id(c: Column) -> Column:
    """xmeas_N or xmv_N in any spelling, else null."""
    family = F.regexp_extract(F.lower(c), r"(xmeas|xmv)[_ ]*\(?0*(\d+)", 1)
    number = F.regexp_extract(F.lower(c), r"(xmeas|xmv)[_ ]*\(?0*(\d+)", 2)
    return F.when(family != "", F.concat_ws("_", family, number))


def stable_id(prefix: str, parts: list[Column], length: int = 16) -> Column:
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha1(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, length))


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))
