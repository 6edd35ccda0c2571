"""Severity, CVSS and CWE as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Severities from low to high; the rank is the place in this list.
SEVERITIES = ["informational", "low", "medium", "high", "critical"]
#: Other words for a severity.
SEVERITY_ALIASES = {"information": "informational", "info": "informational", "none": "informational", "moderate": "medium"}
#: Base metrics of CVSS 3 with their legal values and weights (PR has one weight for each scope).
BASE_METRICS = {
    "AV": {"N": 0.85, "A": 0.62, "L": 0.55, "P": 0.2}, "AC": {"L": 0.77, "H": 0.44}, "PR": {"N": 0.85, "L": 0.62, "H": 0.27}, "UI": {"N": 0.85, "R": 0.62},
    "S": {"U": 0.0, "C": 0.0}, "C": {"N": 0.0, "L": 0.22, "H": 0.56}, "I": {"N": 0.0, "L": 0.22, "H": 0.56}, "A": {"N": 0.0, "L": 0.22, "H": 0.56},
}
CHANGED_PR = {"N": 0.85, "L": 0.68, "H": 0.5}
#: Optional metrics, which are checked but don't count.
OPTIONAL_METRICS = {
    "E": ["X", "U", "P", "F", "H"], "RL": ["X", "O", "T", "W", "U"], "RC": ["X", "U", "R", "C"],
    "CR": ["X", "L", "M", "H"], "IR": ["X", "L", "M", "H"], "AR": ["X", "L", "M", "H"],
    "MAV": ["X", "N", "A", "L", "P"], "MAC": ["X", "L", "H"], "MPR": ["X", "N", "L", "H"], "MUI": ["X", "N", "R"], "MS": ["X", "U", "C"],
    "MC": ["X", "N", "L", "H"], "MI": ["X", "N", "L", "H"], "MA": ["X", "N", "L", "H"],
}


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _switch(key: Column, values: dict, default=None) -> Column:
    out = F.lit(default)
    for k, v in values.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def severity_name(word: Column, default: str | None = "informational") -> Column:
    """The severity a word stands for, any case, aliases included; ``default`` for null, blank and unknown words."""
    w = F.lower(F.trim(word))
    return F.coalesce(_switch(w, {s: s for s in SEVERITIES} | SEVERITY_ALIASES), F.lit(default))


def severity_rank(name: Column) -> Column:
    """0 to 4; null for other words."""
    return _switch(name, {s: i for i, s in enumerate(SEVERITIES)}).cast("int")


def severity_from_rank(rank: Column) -> Column:
    return _switch(rank, dict(enumerate(SEVERITIES)))


def severity_max(*names: Column) -> Column:
    """The highest of several severities; nulls don't count."""
    return severity_from_rank(F.greatest(*[severity_rank(n) for n in names]))


def remote_id(name: Column) -> Column:
    """The remote's 1 to 5 for a severity."""
    return (severity_rank(name) + 1).cast("int")


def severity_from_remote_id(number: Column) -> Column:
    return severity_from_rank(number - 1)


def score_to_severity(score: Column) -> Column:
    """A score's one severity; 3.95 is medium. Null for null."""
    return F.when(score <= 0, "informational").when(score <= 3.9, "low").when(score <= 6.9, "medium").when(score <= 8.9, "high").when(score.isNotNull(), "critical")


def severity_band(score: Column) -> Column:
    """The severities that fit a score, as an array; 0 fits two, 3.95 is low."""
    return (
        F.when(score <= 0, F.array(F.lit("informational"), F.lit("low"))).when(score < 4, F.array(F.lit("low")))
        .when(score < 7, F.array(F.lit("medium"))).when(score < 9, F.array(F.lit("high"))).when(score.isNotNull(), F.array(F.lit("critical")))
    )


def parse_severity_filter(spec: str) -> list[str]:
    """``medium-critical`` (either order, inclusive) or ``high,critical`` to severities; an unknown word raises ValueError."""

    def one(word: str) -> str:
        w = word.strip().lower()
        w = SEVERITY_ALIASES.get(w, w)
        if w not in SEVERITIES:
            raise ValueError(f"unknown severity: {word!r}")
        return w

    if "," not in spec and spec.count("-") == 1:
        low, high = sorted(SEVERITIES.index(one(w)) for w in spec.split("-"))
        return SEVERITIES[low : high + 1]
    return [s for s in SEVERITIES if s in {one(w) for w in spec.split(",") if w.strip()}]


#: What may be wrong with a segment of a vector.
SEGMENT_ERRORS = ["empty segment", "no colon", "duplicate metric", "unknown metric", "illegal value"]


def cvss_parse(vector: Column) -> Column:
    """``struct(version, error)`` of a CVSS 3.0 or 3.1 vector; error is the first that applies, null for a good vector."""
    metrics = {m: list(v) for m, v in BASE_METRICS.items()} | OPTIONAL_METRICS
    legal = [f"{m}:{v}" for m, values in metrics.items() for v in values]

    def checked(parts: Column) -> Column:
        rest = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
        return _let(F.struct(rest.alias("rest"), F.transform(rest, lambda s: F.element_at(F.split(s, ":", 2), 1)).alias("keys")), found)

    def found(x: Column) -> Column:
        rest, keys = x["rest"], x["keys"]

        def wrong(s: Column, i: Column) -> Column:
            key = F.element_at(keys, i + 1)
            return (
                F.when(s == "", SEGMENT_ERRORS[0]).when(~s.contains(":"), SEGMENT_ERRORS[1]).when(F.array_position(keys, key) <= i, SEGMENT_ERRORS[2])
                .when(~key.isin(*metrics), SEGMENT_ERRORS[3]).when(~s.isin(*legal), SEGMENT_ERRORS[4])
            )

        first = F.try_element_at(F.array_compact(F.transform(rest, wrong)), F.lit(1))
        missing = F.size(F.array_except(F.array(*[F.lit(m) for m in BASE_METRICS]), keys)) > 0
        return F.coalesce(first, F.when(missing, "missing metric"))

    version = F.regexp_extract(vector, r"^CVSS:([^/]*)", 1)
    known = version.isin("3.0", "3.1")
    error = F.when(vector.isNull() | ~vector.startswith("CVSS:"), "no prefix").when(~known, "version").otherwise(checked(F.split(vector, "/")))
    return F.struct(F.when(known, version).alias("version"), error.alias("error"))


def metric(vector: Column, name: str) -> Column:
    return F.regexp_extract(vector, rf"/{name}:([A-Z])(?:/|$)", 1)


def cvss_base_score(vector: Column) -> Column:
    """The base score of a good vector, null for others: 3.1 rounds up by whole hundred-thousandths, 3.0 to the nearest tenth."""
    letters = F.struct(*[metric(vector, k).alias(k) for k in BASE_METRICS], cvss_parse(vector).alias("parsed"))

    def weigh(m: Column) -> Column:
        w = {k: _switch(m[k], v) for k, v in BASE_METRICS.items()}
        changed = m["S"] == "C"
        pr = F.when(changed, _switch(m["PR"], CHANGED_PR)).otherwise(w["PR"])
        iss = 1 - (1 - w["C"]) * (1 - w["I"]) * (1 - w["A"])
        ease = 8.22 * w["AV"] * w["AC"] * pr * w["UI"]
        return _let(F.struct(iss.alias("iss"), ease.alias("ease"), changed.alias("changed"), m["parsed"]["version"].alias("version"), m["parsed"]["error"].alias("error")), impact)

    def impact(x: Column) -> Column:
        value = F.when(x["changed"], 7.52 * (x["iss"] - 0.029) - 3.25 * F.pow(x["iss"] - 0.02, F.lit(15.0))).otherwise(6.42 * x["iss"])
        return _let(F.struct(value.alias("impact"), x.alias("x")), whole)

    def whole(y: Column) -> Column:
        x = y["x"]
        raw = F.least(F.lit(10.0), F.when(x["changed"], 1.08 * (y["impact"] + x["ease"])).otherwise(y["impact"] + x["ease"]))
        return _let(F.struct(raw.alias("raw"), F.rint(raw * 100000).alias("n"), y.alias("y")), rounded)

    def rounded(z: Column) -> Column:
        up31 = F.when(z["n"] % 10000 == 0, z["n"] / 100000).otherwise((F.floor(z["n"] / 10000) + 1) / 10)
        x = z["y"]["x"]
        score = F.when(z["y"]["impact"] <= 0, 0.0).when(x["version"] == "3.1", up31).otherwise(F.round(z["raw"] + 1e-9, 1))
        return F.when(x["error"].isNull(), score)

    return _let(letters, weigh)


def cvss2_to_3(vector: Column) -> Column:
    """A CVSS 2 vector as a 3.1 one; null where none of its metrics is there."""
    v = F.concat(F.lit("/"), F.regexp_replace(F.regexp_replace(F.trim(vector), r"^CVSS2#", ""), r"[()]", ""))

    def pick(name: str, values: dict[str, str], default: str) -> Column:
        return F.coalesce(_switch(F.regexp_extract(v, rf"/{name}:([^/]*)", 1), values), F.lit(default))

    effect = {"N": "N", "P": "L", "C": "H"}
    return F.when(
        v.rlike(r"/(AV|AC|Au|C|I|A):"),
        F.concat(
            F.lit("CVSS:3.1/AV:"), pick("AV", {"N": "N", "A": "A", "L": "L"}, "N"), F.lit("/AC:"), pick("AC", {"L": "L", "M": "H", "H": "H"}, "L"), F.lit("/PR:"), pick("Au", {"N": "N", "S": "L", "M": "H"}, "N"),
            F.lit("/UI:N/S:U/C:"), pick("C", effect, "N"), F.lit("/I:"), pick("I", effect, "N"), F.lit("/A:"), pick("A", effect, "N"),
        ),
    )


def ensure_cvss3_prefix(vector: Column, version: str = "3.0") -> Column:
    """Put the version in front of a vector that isn't marked as one of version 3; blank stays blank."""
    v = F.trim(F.coalesce(vector, F.lit("")))
    return F.when((v == "") | v.startswith("CVSS:3"), v).otherwise(F.concat(F.lit(f"CVSS:{version}/"), v))


def cwe_number(text: Column) -> Column:
    """The number in ``CWE-079``, any case, or in a bare number; null where there is none above 0."""
    n = F.try_to_number(F.regexp_extract(F.trim(text), r"(?i)^(?:CWE-)?0*([0-9]{1,9})$", 1), F.lit("999999999")).cast("int")
    return F.when(n > 0, n)


def cwe_label(text: Column) -> Column:
    """``CWE-n``, or an empty string for anything that names none (sentinels of 0 and below included); numbers of any length."""
    n = F.regexp_extract(F.trim(F.coalesce(text, F.lit(""))), r"(?i)^(?:CWE-)?0*([1-9][0-9]*)$", 1)
    return F.when(n != "", F.concat(F.lit("CWE-"), n)).otherwise("")
