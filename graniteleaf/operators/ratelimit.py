"""Token budgets over a ledger of calls, and reading what providers say about limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graniteleaf.config import DEFAULT, Settings
from graniteleaf.functions import text as T

#: Providers: base address and the variable that holds the key (null: none needed). Fixed values.
PROVIDERS = (
    ("groq", "https://api.groq.com/openai/v1", "GROQ_API_KEY"),
    ("openai", "https://api.openai.com/v1", "OPENAI_API_KEY"),
    ("gemini", "https://generativelanguage.googleapis.com/v1beta/openai", "GEMINI_API_KEY"),
    ("ollama", "http://localhost:11434/v1", None),
)


class Unavailable(RuntimeError):
    """No answer from the service after all tries."""


class DailyQuotaExhausted(Unavailable):
    """A quota by the day is used up; trying again does not help before it resets."""


def available(provider: str, environment: dict[str, str]) -> bool:
    keys = {p: key for p, _, key in PROVIDERS}
    return provider in keys and (keys[provider] is None or bool(environment.get(keys[provider])))


def listed_models(models: DataFrame, provider: str) -> list[str]:
    """The models of a provider, from a table models(provider, model) of a few rows; [] if it cannot be read."""
    try:
        return [r["model"] for r in models.where(F.col("provider") == provider).select("model").orderBy("model").collect()]
    except Exception:  # noqa: BLE001 a list of models is only a hint
        return []


def estimate_tokens(messages: DataFrame, by: str, reply: int = DEFAULT.reply_tokens) -> DataFrame:
    """int(characters / 3.5) + reply of each conversation, in binary doubles."""
    return messages.groupBy(by).agg((F.floor(F.coalesce(F.sum(F.length("text")), F.lit(0)).cast("double") / F.lit(3.5)) + reply).cast("long").alias("estimate"))


def rolling_budget(ledger: DataFrame, seconds: int = DEFAULT.window_seconds, limit: float = DEFAULT.tokens_per_minute, key: str = "model", fraction: float = DEFAULT.usage_fraction, limits: DataFrame | None = None, limit_col: str | None = None) -> DataFrame:
    """ledger(key, ts, tokens, ...) with spent (in the window before, both ends included) and would_block.

    The budget is `fraction` of the key's limit: that of limits(key, limit), as latest_limit() learns them, or the call's own `limit_col`, as asof_limits() finds it, else `limit`. A call over
    budget is let through if nothing else lies in its window. Calls are ranked within a key and a stretch of time, with the calls of one window before the
    stretch beside them, so a key with most of the calls is spread over many tasks.
    """
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    width = seconds * 1_000_000
    stretch = max(64 * width, 3_600_000_000)
    own = F.floor(F.col("_at") / stretch).cast("long")
    rows = ledger.withColumn("_at", at)
    # a call that reaches into the next stretch is counted there too, but not returned from there
    both = rows.withColumn("_s", F.explode(F.array_distinct(F.array(own, F.floor((F.col("_at") + width) / stretch).cast("long"))))).withColumn("_own", F.col("_s") == own)
    w = Window.partitionBy(key, "_s").orderBy("_at").rangeBetween(-width, 0)
    both = both.withColumns({"spent": F.sum("tokens").over(w) - F.col("tokens"), "_others": F.count("*").over(w) - 1}).where("_own")
    most = F.lit(float(limit)) if limit_col is None else F.coalesce(F.col(limit_col).cast("double"), F.lit(float(limit)))
    if limits is not None:
        both = both.join(limits.select(F.col(key).alias("_k"), F.col("limit").cast("double").alias("_limit")), F.col(key).eqNullSafe(F.col("_k")), "left").drop("_k")
        most = F.coalesce(F.col("_limit"), most)
    over = F.col("spent") + F.col("tokens") > most * fraction
    return both.withColumn("would_block", (F.col("_others") > 0) & over).drop("_at", "_s", "_own", "_others", "_limit")


def latest_limit(headers: DataFrame, key: str = "model") -> DataFrame:
    return headers.where(F.col("limit").isNotNull()).groupBy(key).agg(F.max_by("limit", "ts").alias("limit"))


def asof_limits(calls: DataFrame, seen: DataFrame, key: str = "model", at: str = "ts", stretch: int = 3600) -> DataFrame:
    """calls(key, at, ...) with `limit`: the one last seen for the key before the call, from seen(key, at, limit); null where none was.

    An as-of join by merging: both sides are sorted together within a key and a stretch of `stretch` seconds, and the last limit of earlier stretches is carried in from one
    row a stretch, so a key with most of the calls is spread over many tasks. A limit seen at the very time of a call is not yet known to it; of limits seen at one time the
    greatest counts. Null keys and times meet nothing, null limits are no limits. A column `limit` of calls is replaced.
    """
    cut = lambda t: F.floor(F.unix_micros(t.cast("timestamp")) / (stretch * 1_000_000)).cast("long")
    calls = calls.drop("limit")
    own = calls.select(F.struct("*").alias("_call"), F.col(key).alias("_k"), F.col(at).alias("_at"), F.lit(None).cast(dict(seen.dtypes)["limit"]).alias("_limit"))
    other = seen.where(F.col("limit").isNotNull() & F.col(key).isNotNull() & F.col(at).isNotNull()).groupBy(F.col(key).alias("_k"), F.col(at).alias("_at")).agg(F.max("limit").alias("_limit"))
    both = own.unionByName(other.withColumn("_call", F.lit(None).cast(own.schema["_call"].dataType))).withColumn("_s", cut(F.col("_at")))
    last = other.withColumn("_s", cut(F.col("_at"))).groupBy("_k", "_s").agg(F.max_by("_limit", "_at").alias("_end"))
    # of every stretch with rows, what the ones before it ended with
    stretches = both.groupBy("_k", "_s").agg(F.count("*").alias("_n")).join(last, ["_k", "_s"], "left")
    carried = stretches.select("_k", "_s", F.last("_end", ignorenulls=True).over(Window.partitionBy("_k").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)).alias("_carried"))
    inside = Window.partitionBy("_k", "_s").orderBy("_at", F.col("_call").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = both.withColumn("_met", F.last("_limit", ignorenulls=True).over(inside)).where("_call IS NOT NULL").join(carried, ["_k", "_s"], "left")
    return met.select("_call.*", F.when(F.col("_k").isNotNull() & F.col("_at").isNotNull(), F.coalesce("_met", "_carried")).alias("limit"))


def classify_status(status: Column, body: Column) -> tuple[Column, Column]:
    """ok, daily_quota (terminal), retry or error; and the minutes until a daily quota resets."""
    daily = (status == 429) & (body.contains("per day") | body.contains("TPD"))
    kind = F.when(daily, "daily_quota").when((status == 429) | (status >= 500), "retry").when(status >= 400, "error").otherwise("ok")
    return kind, F.when(daily, T.duration_seconds(F.regexp_extract(body, "try again in ([0-9hms.]+)", 1)) / 60)


def retry_schedule(failures: DataFrame, tries: int = 8) -> DataFrame:
    """failures(..., status, retry_after) with attempt (from 0) and wait: a row for each wait before the last try; none for what is not tried again."""
    again = failures.where((F.col("status") == 429) | (F.col("status") >= 500))
    return again.withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(tries - 1)))).withColumn("wait", backoff_seconds(F.col("attempt"), F.col("retry_after")))


def backoff_seconds(attempt: Column, retry_after: Column | None = None, settings: Settings = DEFAULT) -> Column:
    """Half a second more than the server's wait, or than 2 * 2**attempt; at most 120."""
    own = F.lit(2.0) * F.pow(F.lit(2.0), attempt)
    return F.least((own if retry_after is None else F.coalesce(retry_after, own)) + 0.5, F.lit(120.0))
