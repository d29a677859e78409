"""Column functions. NULL in gives NULL out unless a function says otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Timestamp forms that are read, in this order.
TIMESTAMP_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd")
#: Exposure for each regime label.
MULTIPLIERS = {"RISK_OFF": 0.5, "NEUTRAL": 1.0, "RISK_ON": 1.2}


def strip(text: Column) -> Column:
    """Without white space at either end; trim() takes blanks only."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def parse_timestamp(raw: Column, formats: tuple[str, ...] = TIMESTAMP_FORMATS) -> Column:
    """The first format that reads the text, ` UTC` and `+00:00` removed; NULL if none does."""
    plain = strip(F.replace(F.replace(raw, F.lit(" UTC"), F.lit("")), F.lit("+00:00"), F.lit("")))
    return F.coalesce(*(F.try_to_timestamp(plain, F.lit(f)) for f in formats))


def content_key(*parts: Column) -> Column:
    """sha256 of the parts joined by `|`, a NULL part counting as empty."""
    return F.sha2(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256)


def chunk_id(text: Column, metadata: Column) -> Column:
    """sha1 of a text and its metadata map in the order of keys."""
    ordered = F.map_from_entries(F.array_sort(F.map_entries(metadata)))
    return F.sha1(F.concat(text, F.to_json(ordered)))


def clean_field(raw: Column, most: int | None = None) -> Column:
    """Trimmed, cut to `most` characters, empty as NULL."""
    text = strip(raw)
    return F.nullif(F.substring(text, 1, most) if most else text, F.lit(""))


def title_and_snippet(title: Column, snippet: Column) -> tuple[Column, Column]:
    """Text to score, and its shape: `title_snippet` or `title_only`."""
    t, s = strip(F.coalesce(title, F.lit(""))), strip(F.coalesce(snippet, F.lit("")))
    return F.when(s != "", F.concat(t, F.lit(". "), s)).otherwise(t), F.when(s != "", F.lit("title_snippet")).otherwise(F.lit("title_only"))


def month_end(day: Column) -> Column:
    return F.last_day(day)


def quarter_end(day: Column) -> Column:
    return F.last_day(F.add_months(F.trunc(day, "quarter"), 2))


def last_completed_month_end(day: Column) -> Column:
    return F.last_day(F.add_months(day, -1))


def clip(x: Column, bound: float) -> Column:
    """Cut to +-bound; NULL stays NULL, which greatest() and least() alone would not keep."""
    return F.when(x.isNotNull(), F.greatest(F.lit(-bound), F.least(F.lit(bound), x)))


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL where b is 0."""
    return F.try_divide(a, b)


def free_cash_flow(operating: Column, spent: Column) -> Column:
    return operating - F.abs(spent)


def shrink(raw: Column, n: Column, prior: Column, k: float = 10.0) -> Column:
    """n/(n+k) of the raw value and k/(n+k) of the prior; without observations the prior."""
    many = F.coalesce(n, F.lit(0))
    return F.when(many == 0, prior).otherwise(many / (many + k) * raw + F.lit(k) / (many + k) * prior)


def graded_regime(vix: Column, spread: Column, off: float = 25.0, on: float = 20.0) -> Column:
    """RISK_OFF wins over RISK_ON; both inputs missing is NEUTRAL."""
    risk_off = (vix > off) | ((vix > on) & (spread < 0))
    risk_on = (vix < on) & (spread > 0)
    return F.when(F.coalesce(risk_off, F.lit(False)), "RISK_OFF").when(F.coalesce(risk_on, F.lit(False)), "RISK_ON").otherwise("NEUTRAL")


def daily_risk_on(vix: Column, spread: Column) -> Column:
    """The binary filter; a missing input is risk-off."""
    return F.coalesce(vix < 25.0, F.lit(False)) & F.coalesce(spread > 0.0, F.lit(False))


def regime_flags(vix: Column, spread: Column, inflation: Column, rate_change: Column) -> dict[str, Column]:
    no = F.lit(False)
    return {
        "risk_on": F.coalesce((vix < 20) & (spread > 0), no),
        "risk_off": F.coalesce(vix > 25, no) | F.coalesce(spread < 0, no),
        "high_inflation": F.coalesce(inflation > 4.0, no),
        "rate_rising": F.coalesce(rate_change > 0.25, no),
    }


def snapshot_label(vix: Column, spread: Column) -> Column:
    """The coarser label of a snapshot; NULL unless both inputs are known."""
    found = F.when((vix > 25) | (spread < 0), "RISK-OFF").when((vix < 18) & (spread > 0.5), "RISK-ON").otherwise("NEUTRAL")
    return F.when(vix.isNotNull() & spread.isNotNull(), found)


def multiplier(label: Column) -> Column:
    found = F.lit(1.0)
    for name, value in MULTIPLIERS.items():
        found = F.when(label == name, F.lit(value)).otherwise(found)
    return found


def blend(rule: Column, second: Column, stale: Column) -> Column:
    """Stale inputs are NEUTRAL; a skipped or agreeing second label leaves the rule's; disagreement is NEUTRAL."""
    return F.when(stale, "NEUTRAL").when((second == "SKIPPED") | (second == rule), rule).otherwise("NEUTRAL")


def sell_rule(f1: Column, f2: Column, lam1: Column, lam2: Column, price: Column, falling: Column, rho: float, cost: float) -> dict[str, Column]:
    """Two-state optimal stopping: discriminant, case, the closed-form threshold of case I, and whether to sell now."""
    a, b = lam1 + rho, lam2 + rho
    phi = (a - f1) * (b - f2) - lam1 * lam2
    d1, d2 = a * f2 + b * f1, a * b - lam1 * lam2
    root = F.sqrt(F.greatest(F.lit(0.0), d1 * d1 - 4 * f1 * f2 * d2))
    beta = F.try_divide(d1 - root, 2 * f1 * f2)
    case1 = F.coalesce(f1 >= rho, F.lit(False)) & F.coalesce(phi > 0, F.lit(False))
    threshold = F.when(case1, F.try_divide(a - f1, a) * F.try_divide(cost * beta, beta - 1))
    case = F.when(phi <= 0, "NONE").when(f1 >= rho, "I").otherwise("II")
    return {"phi": phi, "beta": beta, "case": case, "threshold": threshold, "sell": case1 & falling & F.coalesce(price >= threshold, F.lit(False))}


def outcome(case1: Column, phi_pos: Column, falling: Column, price_ok: Column, second: Column, permits: Column) -> Column:
    return (phi_pos & case1 & falling & price_ok) | (second & permits)


def pivotal(name: str, **conditions: Column) -> Column:
    """Whether forcing the named condition true or false changes the outcome."""
    return outcome(**conditions | {name: F.lit(True)}) != outcome(**conditions | {name: F.lit(False)})


def relevance(raw: Column, path: str) -> Column:
    """A number out of a JSON text; NULL where it is missing or no number."""
    return F.get_json_object(raw, path).try_cast("double")


def first_symbol(text: Column, symbols: list[str]) -> Column:
    """The longest of the known symbols among a text's words, the alphabetically first of equally long ones."""
    words = F.split(F.upper(text), r"[^A-Z0-9]+")
    found = F.array_intersect(F.array(*map(F.lit, sorted({s.upper() for s in symbols}, key=lambda s: (-len(s), s)))), words)
    return F.get(found, F.lit(0))


def year_in_path(path: Column) -> Column:
    return F.nullif(F.regexp_extract(path, r"(19\d\d|20\d\d)", 1), F.lit(""))


def parent_folder(path: Column) -> Column:
    return F.nullif(F.regexp_extract(path, r"([^/]+)/[^/]+$", 1), F.lit(""))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), r"^-|-$", "")


def citation(*parts: Column) -> Column:
    """Parts joined by ` | `; missing and empty ones are left out."""
    return F.concat_ws(" | ", *(F.nullif(p, F.lit("")) for p in parts))
