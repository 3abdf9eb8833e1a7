"""Sequential redaction of secrets and the verdicts drawn from it."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom import constants as K
from auditloom.functions.ecmascript import java_pattern

Pattern = tuple[str, str, bool]

#: Built-in patterns whose starts may overlap, so that a failing match would be tried again from every start in the same run. Each has a
#: pattern of candidates that takes a whole run, or the rest of the text, where the match fails, and the sign by which a candidate
#: is a match. All starts in a run end alike, so the first one decides for them: every character is met a few times at most.
_PEM = r"-----BEGIN\s{kind}PRIVATE\sKEY-----(?:[\s\S]*?-----END\s{kind}PRIVATE\sKEY-----|[\s\S]*+)", r"-----END\s{kind}PRIVATE\sKEY-----$"
CANDIDATES = {
    "PEM Private Key": tuple(x.replace("{kind}", r"(?:RSA\s)?") for x in _PEM),
    "PEM Certificate (private)": tuple(x.replace("{kind}", r"EC\s") for x in _PEM),
    "Generic Secret env variable": (r"""(?:SECRET|TOKEN|PASSWORD|CREDENTIAL|AUTH)[A-Z_]*+(?:\s*[=:]\s*["'][^"']{8,}["'])?""", r"""["']$"""),
    "JSON Web Token": (r"eyJ(?:[A-Za-z0-9_-]{10,}+\.eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]++|[A-Za-z0-9_-]*+)", r"\."),
}


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once."""
    return F.transform(F.array(value), use)[0]


def _linear_step(state: Column, name: str, candidates: Column, sign: str, marker: str, needed: Callable[[Column], Column]) -> Column:
    """A step by candidates: those that bear the sign become the marker, the others stay as they are."""

    def counted(s: Column) -> Column:
        def replaced(found: Column) -> Column:
            n = F.size(F.filter(found, lambda x: x.rlike(sign)))
            parts = F.zip_with(F.split(s["content"], candidates, -1), found, lambda between, x: F.concat(between, F.when(x.isNull(), "").when(x.rlike(sign), marker).otherwise(x)))
            return F.when(n > 0, F.struct(F.array_join(parts, "").alias("content"), (s["n"] + n).cast("long").alias("n"), F.concat(s["names"], F.array(F.lit(name))).alias("names"))).otherwise(s)

        return F.when(needed(s), _let(F.regexp_extract_all(s["content"], candidates, F.lit(0)), replaced)).otherwise(s)

    return _let(state, counted)


def _step(state: Column, name: str, pattern: Column, marker: str, needed: Callable[[Column], Column]) -> Column:
    def counted(s: Column) -> Column:
        found = _let(
            F.regexp_count(s["content"], pattern),
            lambda n: F.when(
                n > 0,
                F.struct(
                    F.regexp_replace(s["content"], pattern, F.lit(marker)).alias("content"),
                    (s["n"] + n).cast("long").alias("n"),
                    F.concat(s["names"], F.array(F.lit(name))).alias("names"),
                ),
            ).otherwise(s),
        )
        return F.when(needed(s), found).otherwise(s)

    return _let(state, counted)


def _holds(text: Column, literals: Sequence[str]) -> Column:
    out = F.lit(False)
    for literal in literals:
        out = out | F.contains(text, F.lit(literal))
    return out


def redact(df: DataFrame, content: str = "content", extra: Sequence[Pattern] = (), marker: str = K.MARKER) -> DataFrame:
    """Adds redacted_count and matched_patterns, and redacts ``content``: pattern after pattern, each on what the last one left.

    A built-in pattern runs only on texts that hold one of the literals its matches need; the built-in marker can't complete a
    literal, another marker might, so with one every later pattern runs once something was redacted. ``extra`` patterns run on all texts.
    The built-in ones take time linear in the text, long runs of one kind included; that of ``extra`` ones is their author's.
    A null content is left null with no matches. The steps nest in one expression, each holding the one before it once: as a
    chain of columns, a filter on the count would be pushed through all of them and double at each step.
    """
    plain = marker == K.MARKER
    quoted = marker.replace("\\", "\\\\").replace("$", "\\$")
    start = F.struct(F.col(content).alias("content"), F.lit(0).cast("long").alias("n"), F.array().cast("array<string>").alias("names"))
    state = start

    def needed(literals: Sequence[str], ignore_case: bool) -> Callable[[Column], Column]:
        held = _holds(F.col("_lower") if ignore_case else F.col(content), literals)
        return lambda s: held if plain else held | (s["n"] > 0)

    for (name, pattern, ignore_case), literals in zip(K.SECRET_PATTERNS, K.SECRET_LITERALS, strict=True):
        if name in CANDIDATES:
            candidates, sign = CANDIDATES[name]
            state = _linear_step(state, name, F.lit(java_pattern(candidates, ignore_case)), java_pattern(sign), marker, needed(literals, ignore_case))
        else:
            state = _step(state, name, F.lit(java_pattern(pattern, ignore_case)), quoted, needed(literals, ignore_case))
    for name, pattern, ignore_case in extra:
        state = _step(state, name, F.lit(java_pattern(pattern, ignore_case)), quoted, lambda s: F.lit(True))
    out = df.withColumn("_lower", F.lower(F.col(content))).withColumn("_r", F.when(F.col(content).isNotNull(), state).otherwise(start)).drop("_lower")
    return out.withColumn(content, F.col("_r.content")).withColumn("redacted_count", F.col("_r.n")).withColumn("matched_patterns", F.col("_r.names")).drop("_r")


def redaction_rows(redacted: DataFrame) -> DataFrame:
    """Only rows with redactions."""
    return redacted.filter(F.col("redacted_count") > 0)


def redaction_totals(redacted: DataFrame) -> DataFrame:
    return redacted.agg(F.coalesce(F.sum("redacted_count"), F.lit(0)).cast("long").alias("total_redacted"), F.count_if(F.col("redacted_count") > 0).alias("files_affected"))


def security_results(files: DataFrame, redactions: DataFrame, order: str | None = None) -> DataFrame:
    """Verdicts without a model: (path, status, message, issues). ``redactions``: (path, redacted_count, matched_patterns).

    Of several reports of a path the last by the column ``order`` wins; without one, that of most redactions.
    """
    found = redactions.groupBy("path").agg(F.max_by(F.struct("redacted_count", "matched_patterns"), order or "redacted_count").alias("r"))
    hit = F.coalesce(F.col("r.redacted_count") > 0, F.lit(False))
    issue = F.struct(F.lit(1.0).alias("line"), F.lit("CRITICAL").alias("severity"), F.concat(F.lit("Potential secret detected ("), F.col("r.redacted_count").cast("string"), F.lit(" redaction(s))")).alias("message"), F.lit(None).cast("string").alias("suggestion"))
    none = F.array().cast("array<struct<line:double,severity:string,message:string,suggestion:string>>")
    return files.select("path").join(found, "path", "left").select(
        "path",
        F.when(hit, "FAIL").otherwise("PASS").alias("status"),
        F.when(hit, F.concat(F.lit("Matched patterns: "), F.array_join("r.matched_patterns", ", "))).otherwise("AI disabled").alias("message"),
        F.when(hit, F.array(issue)).otherwise(none).alias("issues"),
    )
