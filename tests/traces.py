"""Hand-written traces and the replay rules stated as definitions."""

from __future__ import annotations

import random

from feedwake import rules as R
from feedwake import schemas

FIELDS = list(schemas.DECODED_FIELDS)


def event(case, kind, block, tx=0, log=0, stamp=None, tx_hash="", ordinal=0, **decoded):
    full = {f: decoded.get(f) for f in FIELDS}
    return (case, kind, block, stamp, tx, log, tx_hash, "0xmarket", None, ordinal, tuple(full[f] for f in FIELDS))


def trace_frame(spark, events):
    numbered = [(*e[:9], i, e[10]) for i, e in enumerate(events)]
    return spark.createDataFrame(numbered, schemas.TRACE)


def constraint(case, id, kind, asset=None, aliases=None, expected_feed=None, forbidden_feed=None, expected_formula=None,
               heartbeat=None, severity=None):
    return (case, id, kind, asset, aliases, expected_feed, forbidden_feed, expected_formula, None, heartbeat, severity)


def constraint_frame(spark, rows):
    return spark.createDataFrame(rows, schemas.CONSTRAINTS)


def key(value):
    return (value or "").strip().lower().replace(" ", "")


def number(value):
    try:
        return None if value in (None, "") else float(value)
    except ValueError:
        return None


class Seen:
    """One event with its place and comparison keys."""

    def __init__(self, place, raw):
        self.pos = (raw[2] or 0, raw[4] or 0, raw[5] or 0, place)
        self.kind, self.now, self.said = raw[1], raw[3] or 0, dict(zip(FIELDS, raw[10], strict=True))
        self.asset, self.collateral, self.borrowed = (key(self.said[f]) for f in ("asset", "collateral_asset", "borrow_asset"))
        last = self.said["liquidator"] if self.kind == R.LIQUIDATE else self.said["actor"]
        names = [self.said["supplier"], self.said["account"], self.said["actor"]] if self.kind == R.SUPPLY else [self.said["borrower"], self.said["account"], last]
        self.account = key(next((n for n in names if n), ""))

    def breaks(self, c):
        """Whether the event breaks a constraint."""
        covered = {key(n) for n in [c[3], *(c[4] or [])] if n}
        if R.KIND_OF_EVENT.get(self.kind) != c[2] or self.asset not in covered:
            return False
        feed = key(self.said["actual_feed"])
        age = self.now - (self.said["updated_at"] or self.now)
        return {
            R.FEED_SET: (bool(c[6]) and feed == key(c[6])) or (bool(c[5]) and feed != key(c[5])),
            R.FORMULA_SET: key(self.said["actual_formula"]) != key(self.said["expected_formula"] if c[7] is None else c[7]),
            R.ANSWER: (bool(c[9]) and c[9] > 0 and age > c[9]) or bool(self.said["lower_bound_hit"]),
        }.get(self.kind, True)


def by_definition(events, constraints):
    """Alerts as (type, position, reasons) of one case and its accounts in order, each stated for itself from all events."""
    seen = sorted((Seen(i, e) for i, e in enumerate(events)), key=lambda e: e.pos)
    broken = [(e, c) for e in seen for c in constraints if e.breaks(c)]
    marks = [e for e in seen if R.KIND_OF_EVENT.get(e.kind) and (e.kind != R.ANSWER or any(x is e for x, _ in broken))]

    def bad(asset, before):
        """Kinds that mark an asset before a place."""
        return {R.KIND_OF_EVENT[m.kind] for m in marks if m.asset == asset and m.pos < before}

    def proven(asset, before):
        """Kinds of broken constraints of an asset before a place."""
        return {c[2] for e, c in broken if e.asset == asset and e.pos < before} if asset else set()

    risky = [e for e in seen if e.kind == R.SUPPLY and e.account and proven(e.asset, e.pos)]

    def amount(e):
        return max(number(e.said["amount"]) or 0.0, 0.0)

    def material(e):
        held = sum(amount(x) for x in risky if (x.account, x.asset) == (e.account, e.asset) and x.pos < e.pos)
        return amount(e) > 0 and (held <= 0 or amount(e) / held >= 0.1)

    reasons = {}
    for impact in seen:
        if impact.kind not in R.IMPACT_TYPES or not impact.account:
            continue
        built = [e for e in risky if (e.account, e.asset) == (impact.account, impact.collateral) and e.pos < impact.pos]
        prefix = "stale_oracle" if "stale_oracle" in proven(impact.collateral, impact.pos) else "bad_oracle"
        chosen = [(e, "first_risky_collateral_supply") for e in built[:1]] + [(e, "latest_topup_before_impact") for e in built[-1:]]
        chosen += [(e, "material_collateral_increase_>=10%") for e in built if material(e)]
        for e, why in chosen:
            reasons.setdefault(e.pos, (e, set()))[1].add(f"{prefix}:{why}")

    def against(e):
        """Why a borrow is odd."""
        why = bad(e.collateral, e.pos)
        if "formula_mismatch" in bad(e.borrowed, e.pos):
            why = why | {"borrow_asset_formula_mismatch"}
        reported, expected = number(e.said["collateral_value_usd_reported"]), number(e.said["collateral_value_usd_expected"])
        inflated = reported is not None and expected is not None and expected > 0 and reported / expected > 10
        return why | {"collateral_value_inflated"} if inflated else why

    borrows = [(e, against(e)) for e in seen if e.kind == R.BORROW and against(e)]
    seized = [e for e in seen if e.kind == R.LIQUIDATE and bad(e.collateral, e.pos) & {"feed_mismatch", "formula_mismatch"}]
    alerts = [(c[2], e.pos, c[1]) for e, c in broken]
    alerts += [(R.STALE_SUPPLY if "stale_oracle" in bad(e.asset, e.pos) else R.BAD_SUPPLY, pos, "|".join(sorted(why))) for pos, (e, why) in reasons.items()]
    alerts += [(R.LOCALIZATION, e.pos, "|".join(sorted(why))) for e, why in borrows] + [(R.LOCALIZATION, e.pos, "") for e in seized]
    named = [(e.pos, 0, e.said["borrower"] or e.said["account"]) for e, _ in borrows] + [(e.pos, 0, e.said["liquidator"]) for e in seized]
    named += [(e.pos, 1, e.said["actor"]) for e, _ in borrows if key(e.said["actor"]) != key(e.said["borrower"] or e.said["account"])]
    return sorted(alerts), list(dict.fromkeys(name for *_, name in sorted(named, key=lambda n: n[:2]) if name))


def random_case(seed):
    rng = random.Random(seed)
    case = f"case{seed}"
    assets = ["AAA", "AAA", "B BB", "cc", ""]
    people = ["ann", "ann", "Bob", ""]
    events = []
    for i in range(rng.randint(20, 80)):
        kind = rng.choice([R.FEED_SET, R.FORMULA_SET, R.ANSWER, R.STALE_START, R.MALFUNCTION, R.MISMATCH, R.SUPPLY, R.SUPPLY,
                           R.SUPPLY, R.BORROW, R.BORROW, R.LIQUIDATE, "ORACLE_FEED_REPAIRED"])
        d = {}
        if kind in R.DANGER_TYPES:
            d = {"asset": rng.choice(assets + ["b bb", "alias1"]), "actual_feed": rng.choice(["F0", "f1", "bad"]),
                 "actual_formula": rng.choice(["x*y", "x"]), "expected_formula": rng.choice([None, "x*y"]),
                 "updated_at": rng.choice([None, 0, 1000, 5000]), "lower_bound_hit": rng.choice([None, False, True])}
        elif kind == R.SUPPLY:
            d = {"asset": rng.choice(assets + ["bbb"]), rng.choice(["supplier", "account", "actor"]): rng.choice(people),
                 "amount": rng.choice([None, "unknown", "0", "-5", "9", "10", "11", "100", "1e2"])}
        else:
            d = {"collateral_asset": rng.choice(assets), "borrow_asset": rng.choice(assets), rng.choice(["borrower", "account"]): rng.choice(people),
                 "actor": rng.choice(people), "liquidator": rng.choice(people), "borrow_amount": "7",
                 "collateral_value_usd_reported": rng.choice([None, "100", "x"]), "collateral_value_usd_expected": rng.choice([None, "9", "0"])}
        events.append(event(case, kind, rng.randint(0, 12), rng.randint(0, 2), rng.randint(0, 2), rng.choice([None, 4000, 6000]),
                            rng.choice(["", f"0x{i}"]), **d))
    rules = []
    for n, asset in enumerate(rng.sample(["aaa", "BBB", "CC"], 2)):
        rules.append(constraint(case, f"feed{n}", "feed_mismatch", asset, rng.choice([None, ["alias1"]]), rng.choice([None, "F0"]), rng.choice([None, "BAD"])))
        rules.append(constraint(case, f"formula{n}", "formula_mismatch", asset, expected_formula=rng.choice([None, "x*y"])))
        if rng.random() < 0.7:
            rules.append(constraint(case, f"stale{n}", "stale_oracle", asset, heartbeat=rng.choice([None, 0, 500, 2000])))
        if rng.random() < 0.5:
            rules.append(constraint(case, f"outlier{n}", "price_source_outlier", asset))
            rules.append(constraint(case, f"decimal{n}", "decimal_semantics_mismatch", asset, severity="low"))
    return case, events, rules
