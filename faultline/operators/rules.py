"""Rules that adjust a case's ranking one after another, as data."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cases whose rows are Python objects at a time.
CASES = 200
#: The anchors that the rules are about.
SEPARATOR, CONDENSER, STREAM4, STREAM2, STRIPPER, MULTI_VALVE, SEPARATOR_INLET = (
    f"faultanchor:{n}"
    for n in (
        "separator_coolant_valve_stiction",
        "condenser_heat_transfer",
        "stream_4_feed_temperature",
        "stream_2_feed_temperature",
        "stripper_heat_transfer",
        "multi_valve_stiction",
        "separator_cooling_inlet_temperature",
    )
)
#: An anchor this close behind its target is raised to it; the separator family and when it acts.
PROXY_MARGIN = 0.09
FAMILY = (SEPARATOR_INLET, SEPARATOR, CONDENSER)
FAMILY_ACTIVATION, FAMILY_RANK, FAMILY_GAP, FAMILY_SHARED, FAMILY_UNIQUE, FAMILY_TOP = 0.60, 3, 0.12, 0.30, 0.20, 8


@dataclass(frozen=True)
class Signal:
    """A bounded reading, 0 to 1, of the largest of some features.

    rise: above a threshold, in scales; fall: below it; size: of its size above it; band: how near the middle of two bounds.
    """

    features: tuple[str, ...]
    kind: str
    a: float
    b: float
    weight: float = 1.0
    needed: bool = True

    def read(self, features: dict) -> float:
        v = max(float(features.get(f) or 0.0) for f in self.features)
        if self.kind == "band":
            x = 1 - abs(v - (self.a + self.b) / 2) / ((self.b - self.a) / 2)
        else:
            v = abs(v) if self.kind == "size" else v
            x = (self.a - v if self.kind == "fall" else v - self.a) / self.b
        return round(max(0.0, min(1.0, x)), 8)


@dataclass(frozen=True)
class Gate:
    """A column of the target, of the leader, of either (the larger), or of a named candidate, within bounds; absent is 0.

    lead: by how much the target's value is ahead of the leader's, instead.
    """

    who: str
    column: str
    low: float = float("-inf")
    high: float = float("inf")


@dataclass(frozen=True)
class Rule:
    """Raises a target that trails a certain leader narrowly.

    The bonus is `most` times the signature (times a column of the target, `scaled_by`), or, with a margin, what the
    target lacks to lead by it, `most` at most.
    """

    name: str
    target: str
    leaders: tuple[str, ...]
    max_gap: float
    most: float
    max_rank: int = 1 << 30
    second: str | None = None
    needs: tuple[str, ...] = ()
    signals: tuple[Signal, ...] = ()
    largest: bool = False
    least: float = 0.0
    gates: tuple[Gate, ...] = ()
    margin: float | None = None
    scaled_by: str | None = None
    enabled: bool = True

    def signature(self, features: dict) -> float:
        """The weighted sum, or the largest, of the signals; 0 if one that is needed is 0."""
        read = [s.read(features) for s in self.signals]
        if self.largest:
            return max(read, default=0.0)
        if any(s.needed and r <= 0 for s, r in zip(self.signals, read)):
            return 0.0
        return round(min(1.0, sum(s.weight * r for s, r in zip(self.signals, read))), 8)


def _std(n: int, a: float, b: float, weight: float, needed: bool = True) -> Signal:
    return Signal((f"xmeas_{n}__std",), "rise", a, b, weight, needed)


def _mean(n: int, kind: str, a: float, b: float, weight: float = 1.0) -> Signal:
    return Signal((f"xmeas_{n}__mean",), kind, a, b, weight)


_STREAM2 = (_mean(21, "size", 0.114, 0.03), _mean(30, "rise", 0.0612, 0.0012))
_DRIFT = Signal(("xmeas_18__mean", "xmeas_19__mean", "xmv_9__mean"), "rise", 0.0, 0.05, 0.20)
#: The rules in the order in which they act, after anchors are preferred and the family has acted.
RULES = (
    Rule("condenser_dynamic", CONDENSER, (), 1.50, 1.40, 3, signals=(_std(22, 5.0, 7.0, 0.45), _mean(22, "fall", -0.5, 4.5, 0.40), _std(11, 4.0, 2.5, 0.15, False)), gates=(Gate("target", "family_activation", 0.60),), scaled_by="family_activation"),
    Rule("stream4_cold_response", STREAM4, (STRIPPER,), 0.75, 0.80, 2, needs=(STRIPPER,), signals=(_mean(18, "fall", -1.0, 0.5, 0.45), _mean(19, "rise", 0.5, 0.4, 0.35), Signal(("xmeas_19__std",), "band", 1.0, 2.2, 0.20))),
    Rule(
        "stream4_proxy_chase", STREAM4, (SEPARATOR, MULTI_VALVE), 0.12, 0.14, 4, margin=0.01,
        gates=(Gate("target", "stream4_cold_response_signature", high=0.0), Gate("target", "unique_alignment", 0.30), Gate("target", "discriminator_alignment", 0.25), Gate("leader", "discriminator_alignment", high=0.12), Gate("lead", "memory_bonus", -0.25)),
    ),
    Rule("stream2_competition", STREAM2, (SEPARATOR,), 0.45, 0.50, 3, needs=(SEPARATOR,), signals=_STREAM2, largest=True),
    Rule(
        "stream2_competition", STREAM2, (CONDENSER,), 0.35, 0.50, 5, second=SEPARATOR, needs=(SEPARATOR,), signals=_STREAM2, largest=True, least=0.95,
        gates=(Gate("behind", "score", high=0.12), Gate("pair", "family_activation", 0.50), Gate("leader", "condenser_dynamic_signature", high=0.0)),
    ),
    Rule(
        "separator_valve_tiebreak", SEPARATOR, (CONDENSER,), 0.12, 0.14, second=SEPARATOR, margin=0.01,
        gates=(Gate("either", "family_activation", 0.50), Gate("leader", "condenser_dynamic_signature", high=0.0), Gate(STREAM2, "stream2_competition_signature", high=0.20), Gate("lead", "memory_bonus", 0.005)),
    ),
    Rule(
        "stripper_tiebreak", STRIPPER, (STREAM4,), 0.08, 0.10, second=STRIPPER, margin=0.01,
        gates=(Gate("leader", "stream4_cold_response_signature", high=0.0), Gate("leader", "stream4_variance_signature", high=0.0), Gate("lead", "memory_bonus", 0.04), Gate("lead", "unique_alignment", 0.10)),
    ),
    # the next two are defined, but do not act
    Rule("stream4_variance", STREAM4, (STRIPPER, SEPARATOR, STREAM2), 0.14, 0.14, 4, signals=(_std(18, 1.20, 0.35, 1.0),), margin=0.01, enabled=False),
    Rule("stripper_thermal", STRIPPER, (STREAM4, SEPARATOR), 0.16, 0.15, 5, signals=(_std(19, 1.20, 0.30, 1.0),), margin=0.01, enabled=False),
    Rule(
        "condenser_moderate", CONDENSER, (SEPARATOR, STREAM2, MULTI_VALVE), 0.18, 0.16, 5, margin=0.01,
        signals=(_std(22, 1.00, 0.60, 0.50), _mean(22, "fall", -0.12, 0.28, 0.35), _std(11, 0.80, 0.25, 0.15, False)), gates=(Gate("target", "condenser_dynamic_signature", high=0.0),),
    ),
    Rule(
        "separator_warm", SEPARATOR, (STREAM2,), 0.14, 0.14, second=SEPARATOR, margin=0.01,
        signals=(_std(22, 1.00, 0.12, 0.35), _std(11, 0.88, 0.10, 0.25), _mean(22, "rise", -0.05, 0.10, 0.20), _DRIFT), gates=(Gate("leader", "stream2_competition_signature", high=0.0),),
    ),
)


@dataclass
class Ranking:
    """A case's candidates (id, base and what the gates read); adjustments and signatures are kept in their rows."""

    rows: list[dict]
    features: dict = field(default_factory=dict)

    def __post_init__(self):
        for r in self.rows:
            r["adjustment"] = float(r.get("adjustment") or 0.0)
            r["score"] = round(r["base"] + r["adjustment"], 8)
        self.by = {r["id"]: r for r in self.rows}
        self._order: list[dict] | None = None

    def ordered(self) -> list[dict]:
        """The rows in their order, sorted again only after one has been raised."""
        if self._order is None:
            self._order = self._sorted()
        return self._order

    def _sorted(self) -> list[dict]:
        return sorted(self.rows, key=lambda r: (-r["score"], -float(r.get("root_score") or 0.0), float(r.get("priority") or 0.0), str(r.get("type") or ""), str(r["id"]), -float(r.get("covered_mass") or 0.0)))

    def raise_by(self, row: dict, bonus: float) -> None:
        self._order = None
        row["adjustment"] = round(row["adjustment"] + bonus, 8)
        row["score"] = round(row["base"] + row["adjustment"], 8)

    def prefer_anchors(self) -> None:
        """A root-cause anchor at most PROXY_MARGIN behind a target of its own gets what is left of the margin."""
        for r in self.rows:
            if r.get("role") != "root_cause_anchor":
                continue
            targets = [self.by[t] for t in str(r.get("direct_targets") or "").split("|") if t in self.by]
            left = [PROXY_MARGIN - max(0.0, t["base"] - r["base"]) for t in targets if t.get("role") != "root_cause_anchor"]
            if left and max(left) > 0:
                self.raise_by(r, max(left))

    def apply_family(self, contributions: dict, diagnostics: dict) -> None:
        """The separator family shares a bonus if its variables hold most of the evidence and it competes for the lead."""
        own = {a: set(diagnostics.get(a) or ()) for a in FAMILY}
        mass = sum(sorted((v for v in contributions.values() if v > 0), reverse=True)[:FAMILY_TOP])
        if not all(own.values()) or mass <= 0:
            return
        share = lambda ids: sum(contributions.get(i, 0.0) for i in ids) / mass
        activation = round(share(set().union(*own.values())), 8)
        order = self.ordered()
        family = [r for r in order if r["id"] in own]
        if not family:
            return
        acts = activation >= FAMILY_ACTIVATION and order.index(family[0]) < FAMILY_RANK and order[0]["score"] - family[0]["score"] <= FAMILY_GAP
        for r in family:
            r["family_activation"] = activation
            alone = own[r["id"]] - set().union(*(v for a, v in own.items() if a != r["id"]))
            if acts:
                self.raise_by(r, FAMILY_SHARED * activation * round(share(own[r["id"]]), 8) + FAMILY_UNIQUE * round(share(alone), 8))

    def _value(self, gate: Gate, target: dict, order: list[dict]) -> float:
        read = lambda r: float((r or {}).get(gate.column) or 0.0)
        leader, next_one = order[0], order[1] if len(order) > 1 else order[0]
        if gate.who == "lead":
            return read(target) - read(leader)
        if gate.who == "behind":
            return read(leader) - read(next_one)
        if gate.who in ("either", "pair"):
            return max(read(leader), read(target if gate.who == "either" else next_one))
        return read({"target": target, "leader": leader}.get(gate.who) or self.by.get(gate.who))

    def apply(self, rule: Rule) -> None:
        target = self.by.get(rule.target)
        if not rule.enabled or target is None or any(n not in self.by for n in rule.needs):
            return
        signature = rule.signature(self.features)
        if rule.signals:
            target[f"{rule.name}_signature"] = signature
            if signature <= 0 or signature < rule.least:
                return
        order = self.ordered()
        gap = max(0.0, order[0]["score"] - target["score"])
        fits = (
            order.index(target) < rule.max_rank
            and (not rule.leaders or order[0]["id"] in rule.leaders)
            and (rule.second is None or len(order) > 1 and order[1]["id"] == rule.second)
            and round(gap, 8) <= rule.max_gap
            and all(g.low <= round(self._value(g, target, order), 8) <= g.high for g in rule.gates)
        )
        if not fits:
            return
        scale = float(target.get(rule.scaled_by) or 0.0) if rule.scaled_by else 1.0
        bonus = min(rule.most, gap + rule.margin) if rule.margin is not None else rule.most * signature * scale
        if bonus > 0:
            self.raise_by(target, bonus)
            target[f"{rule.name}_bonus"] = round(bonus, 8)


def _structs(lists):
    """Each list of an Arrow column as dictionaries, by way of the columns of all of them; a null list is an empty one."""
    flat = lists.flatten()
    names = [flat.type.field(i).name for i in range(flat.type.num_fields)]
    rows = [dict(zip(names, values)) for values in zip(*[c.to_pylist() for c in flat.flatten()])]
    at = 0
    for n in lists.value_lengths().to_pylist():
        yield rows[at : at + (n or 0)]
        at += n or 0


def adjust(candidates: DataFrame, features: DataFrame, diagnostics: dict[str, list[str]] | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """case_id, id, rank, score, adjustment, and the bonus of each rule (0 for those that do not act).

    candidates: case_id, id, base, role, direct_targets and whatever columns the gates read. features: case_id, kind
    (dynamic or contribution), feature, value; a null value is as if it were not there. diagnostics: the variables of the
    family's anchors. A case has a few dozen candidates and features, so it is one row with two lists.
    """
    extra = [c for c in candidates.columns if c not in ("case_id", "id", "base")]
    names = list(dict.fromkeys(r.name for r in rules))
    schema = "case_id string, id string, rank long, score double, adjustment double, " + ", ".join(f"{n}_bonus double" for n in names)

    def run(batches):
        import pyarrow as pa

        kinds = [pa.string(), pa.string(), pa.int64(), *[pa.float64()] * (2 + len(names))]
        columns = ["case_id", "id", "rank", "score", "adjustment", *[f"{n}_bonus" for n in names]]
        for batch in batches:
            for at in range(0, batch.num_rows, CASES):
                out = []
                part = batch.slice(at, CASES)
                for case, own, seen in zip(part.column("case_id").to_pylist(), _structs(part.column("rows")), _structs(part.column("features"))):
                    said = {"dynamic": {}, "contribution": {}}
                    for f in seen:
                        if f["value"] is not None:
                            said.setdefault(f["kind"], {})[f["feature"]] = f["value"]
                    ranking = Ranking([r | {"base": float("nan" if r["base"] is None else r["base"])} for r in own], said["dynamic"])
                    ranking.prefer_anchors()
                    ranking.apply_family(said["contribution"], diagnostics or {})
                    for rule in rules:
                        ranking.apply(rule)
                    out += [(case, r["id"], i + 1, r["score"], r["adjustment"], *[r.get(f"{n}_bonus", 0.0) for n in names]) for i, r in enumerate(ranking.ordered())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], columns)

    rows = candidates.groupBy("case_id").agg(F.collect_list(F.struct("id", "base", *extra)).alias("rows"))
    read = features.groupBy("case_id").agg(F.collect_list(F.struct("kind", "feature", "value")).alias("features"))
    # dealt by a count and not by sizes: a case is few bytes for the work that it is, and small partitions would be merged into one task
    n = int(candidates.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.join(read, "case_id", "left").repartition(n, F.xxhash64("case_id")).mapInArrow(run, schema)
