"""Column functions: names, dates, ladders, geometry, probabilities. All built in but ``norm_name_full``."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the domain: goal centre and posts, cut-offs of progressive moves, labels.
GOAL_X, GOAL_Y, POST_LOW, POST_HIGH = 120.0, 40.0, 36.0, 44.0
PROGRESSIVE_PASS, PROGRESSIVE_CARRY, CARRY_END_X = 25.0, 10.0, 48.0
DATE_FORMATS = ("yyyy-MM-dd", "dd/MM/yyyy", "MM/dd/yyyy", "dd-MM-yyyy")
MAX_GOALS = 8

_FROM = "áàâäãåéèêëíìîïóòôöõúùûüñçýÿ"
_TO = "aaaaaaeeeeiiiiooooouuuuncyy"


def norm_name(c: Column) -> Column:
    """Lower case, Latin accents dropped, generational suffixes dropped, letters and single spaces only; null gives ''."""
    s = F.translate(F.lower(F.coalesce(c, F.lit(""))), _FROM, _TO)
    s = F.regexp_replace(s, r"\b(jr|sr|ii|iii|iv)\b", "")
    return F.trim(F.regexp_replace(F.regexp_replace(s, r"[^a-z\s]", ""), r"\s+", " "))


@F.pandas_udf(T.StringType())
def norm_name_full(names: pd.Series) -> pd.Series:
    """As ``norm_name`` for every script that Unicode can decompose."""
    s = names.fillna("").str.normalize("NFKD").str.replace(r"[̀-ͯ]", "", regex=True).str.lower()
    s = s.str.replace(r"\b(?:jr|sr|ii|iii|iv)\b", "", regex=True).str.replace(r"[^a-z\s]", "", regex=True)
    return s.str.replace(r"\s+", " ", regex=True).str.strip()


def or_unknown(c: Column, other: str = "Unknown") -> Column:
    return F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(other))


def label(*parts: Column, sep: str = " · ") -> Column:
    return F.concat_ws(sep, *[F.nullif(F.trim(p), F.lit("")) for p in parts])


def candidate_names(first: Column, last: Column, full: Column) -> Column:
    """first last, full and initial last, normalised, without blanks and repeats."""
    tries = F.array(norm_name(F.concat_ws(" ", first, last)), norm_name(full), norm_name(F.concat_ws(" ", F.substring(first, 1, 1), last)))
    return F.array_distinct(F.filter(tries, lambda x: x != ""))


def parse_date(c: Column) -> Column:
    """The first of the known formats that parses."""
    return F.coalesce(*[F.try_to_date(c, f) for f in DATE_FORMATS])


def safe_int(c: Column) -> Column:
    return c.try_cast("double").try_cast("int")


def age_years(on: Column, born: Column) -> Column:
    """Full years; a 29 February birthday counts from 1 March in other years."""
    before = (F.month(on) * 100 + F.dayofmonth(on)) < (F.month(born) * 100 + F.dayofmonth(born))
    return F.year(on) - F.year(born) - before.cast("int")


def result_of(own: Column, other: Column) -> Column:
    return F.when(own > other, "win").when(own < other, "loss").when(own == other, "draw")


def points_of(own: Column, other: Column) -> Column:
    return F.when(own > other, 3).when(own == other, 1).otherwise(0)


def weather_label(precip: Column, wind: Column, temp: Column) -> Column:
    p, w, t = F.coalesce(precip, F.lit(0.0)), F.coalesce(wind, F.lit(0.0)), F.coalesce(temp, F.lit(15.0))
    return F.when(p >= 5, "heavy_rain").when(p >= 1, "rain").when(w >= 50, "windy").when(t < 5, "cold").when(t >= 30, "hot").otherwise("clear")


def position_group(c: Column) -> Column:
    """GK, DEF, MID, and FWD for all other names; unknown for none. A wing back is a back."""
    return F.when(c.isNull() | (c == ""), "unknown").when(c.contains("Goalkeeper"), "GK").when(c.contains("Back"), "DEF").when(c.contains("Midfield"), "MID").otherwise("FWD")


#: The broad group of each position name of the event data.
BROAD_POSITIONS = {
    "GK": ["Goalkeeper"],
    "CB": ["Center Back", "Left Center Back", "Right Center Back"],
    "FB": ["Left Back", "Right Back", "Left Wing Back", "Right Wing Back"],
    "DM": ["Center Defensive Midfield", "Left Defensive Midfield", "Right Defensive Midfield"],
    "CM": ["Center Midfield", "Left Center Midfield", "Right Center Midfield"],
    "AM": ["Center Attacking Midfield", "Left Attacking Midfield", "Right Attacking Midfield"],
    "WM": ["Left Midfield", "Right Midfield"],
    "W": ["Left Wing", "Right Wing"],
    "ST": ["Center Forward", "Left Center Forward", "Right Center Forward", "Secondary Striker"],
}
#: The coarse group of position names; any other name is Other.
COARSE_POSITIONS = {
    "Goalkeeper": ["Goalkeeper"],
    "Defender": ["Center Back", "Left Back", "Right Back", "Left Center Back", "Right Center Back", "Left Wing Back", "Right Wing Back"],
    "Midfielder": [
        "Center Midfield", "Defensive Midfield", "Left Center Midfield", "Right Center Midfield", "Left Midfield", "Right Midfield", "Attacking Midfield",
    ],
    "Attacker": ["Left Wing", "Right Wing", "Center Forward", "Left Center Forward", "Right Center Forward", "Secondary Striker"],
}


def _grouped(c: Column, groups: dict[str, list[str]]) -> Column:
    out = F.lit(None).cast("string")
    for group, names in groups.items():
        out = F.when(c.isin(names), group).otherwise(out)
    return out


def broad_position(c: Column) -> Column:
    """One of nine groups; null for any other name."""
    return _grouped(c, BROAD_POSITIONS)


def coarse_position(c: Column) -> Column:
    """One of four groups, Other for any other name, null for null."""
    return F.when(c.isNotNull(), F.coalesce(_grouped(c, COARSE_POSITIONS), F.lit("Other")))


def place_name(c: Column) -> Column:
    """A place's name without replacement characters, parentheses and runs of spaces; null gives an empty name."""
    plain = F.regexp_replace(F.translate(F.coalesce(c, F.lit("")), "\ufffd", " "), r"\(.*?\)", " ")
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def recency_bucket(days: Column) -> Column:
    return F.when(days < 0, "no_history").when(days <= 30, "0-30d").when(days <= 90, "31-90d").otherwise("91-180d")


def risk_label(p: Column) -> Column:
    return F.when(p >= 0.67, "high").when(p >= 0.4, "medium").otherwise("low")


def body_part(c: Column) -> Column:
    return F.when(c.isin("Right Foot", "Left Foot", "Head"), c).otherwise("Other")


def rate(x: Column, n: Column, scale: float = 100.0) -> Column:
    return F.when(n > 0, x / n * scale).otherwise(0.0)


def per90(x: Column, minutes: Column) -> Column:
    return F.when(minutes > 0, x / (minutes / 90.0))


def clip(c: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), c))


def log1p_clipped(c: Column) -> Column:
    return F.log1p(F.greatest(c, F.lit(0.0)))


def distance(x1: Column, y1: Column, x2: Column | float = GOAL_X, y2: Column | float = GOAL_Y) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.sqrt(F.pow(lit(x2) - x1, F.lit(2.0)) + F.pow(lit(y2) - y1, F.lit(2.0)))


def shot_angle(x: Column, y: Column) -> Column:
    """Angle between the posts; 0 on a post."""
    ax, ay, by = F.lit(GOAL_X) - x, F.lit(POST_LOW) - y, F.lit(POST_HIGH) - y
    n1, n2 = F.sqrt(ax * ax + ay * ay), F.sqrt(ax * ax + by * by)
    return F.when((n1 == 0) | (n2 == 0), 0.0).otherwise(F.acos(clip((ax * ax + ay * by) / (n1 * n2), -1.0, 1.0)))


def in_cone(px: Column, py: Column, x: Column, y: Column) -> Column:
    """Whether a point is in the triangle of shot and posts, edges included."""
    side = lambda ax, ay, bx, by: (px - bx) * (ay - by) - (ax - bx) * (py - by)
    g, lo, hi = F.lit(GOAL_X), F.lit(POST_LOW), F.lit(POST_HIGH)
    d = [side(x, y, g, lo), side(g, lo, g, hi), side(g, hi, x, y)]
    neg, pos = (d[0] < 0) | (d[1] < 0) | (d[2] < 0), (d[0] > 0) | (d[1] > 0) | (d[2] > 0)
    return ~(neg & pos)


def elo_expected(own: Column, other: Column, edge: float = 0.0) -> Column:
    return 1.0 / (1.0 + F.pow(F.lit(10.0), -(own + edge - other) / 400.0))


def poisson(k: int, lam: Column) -> Column:
    """Probability of ``k``, without the factor exp(-lam)."""
    power = F.lit(1.0)
    for i in range(1, k + 1):
        power = power * lam / F.lit(float(i))
    return power


def expected_points(own: Column, other: Column) -> Column:
    """Points expected from two Poisson scores of 0 to 8 goals: plain arithmetic, which code generation takes whole.

    3 P(i > j) + P(i = j) as nested products over the lower score, each term from the one before it.
    """
    nested = F.lit(0.0)  # from the highest score down: sum over i of own^i / i! * (3 * others below i + others at i)
    for i in range(MAX_GOALS, -1, -1):
        below = F.lit(0.0)
        for j in range(i - 1, -1, -1):
            below = (below * other / F.lit(float(j + 1))) + F.lit(1.0) if j < i - 1 else F.lit(1.0)
        nested = (F.lit(3.0) * below + poisson(i, other)) + (nested * own / F.lit(float(i + 1)))
    return F.exp(-own - other) * nested


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two numeric arrays; 0 if one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, v: s + v)
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def fuzzy_ratio(a: Column, b: Column) -> Column:
    """Edit similarity in percent."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest > 0, (1 - F.levenshtein(a, b) / longest) * 100).otherwise(100.0)
