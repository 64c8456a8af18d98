"""Rule ladders of the tools: symbols, importance, routes, hours, errors, schedules, formats."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quayline.functions.numeric import col, rounded

#: fixed values: class of an error -> patterns and texts that tell it; the first class that is told wins
ERROR_CLASSES = {
    "context_overflow": (
        (),
        (
            "context length exceeded",
            "maximum context length",
            "this model's maximum context length",
            "prompt is too long",
            "request_too_large",
            "exceeds model context window",
            "context overflow",
            "exceed context limit",
            "model token limit",
            "your request exceeded model token limit",
            "上下文过长",
            "上下文超出",
            "超出最大上下文",
        ),
    ),
    "rate_limit": (
        (r"rate[_ ]limit|too many requests|429",),
        ("model_cooldown", "cooling down", "exceeded your current quota", "resource has been exhausted", "quota exceeded", "resource_exhausted", "usage limit", "tpm", "tokens per minute"),
    ),
    "billing": ((r"""["']?(?:status|code)["']?\s*[:=]\s*402\b""", r"\bhttp\s*402\b"), ("payment required", "insufficient credits", "credit balance", "insufficient balance")),
    "auth": ((r"invalid[_ ]?api[_ ]?key", r"\b401\b", r"\b403\b"), ("incorrect api key", "invalid token", "authentication", "unauthorized", "forbidden", "access denied", "no api key found")),
    "timeout": ((), ("timeout", "timed out", "deadline exceeded", "context deadline exceeded")),
    "overloaded": ((r'overloaded_error|"type"\s*:\s*"overloaded_error"',), ("overloaded", "service unavailable", "high demand")),
}
#: fixed values: texts that tell an overflow together, and texts that rule it out
OVERFLOW_TOGETHER = (("request size exceeds", "context"), ("max_tokens", "exceed", "context"), ("input length", "exceed", "context"), ("413", "too large"))
NO_OVERFLOW = ("tpm", "tokens per minute")
BACKOFF_SECONDS = (30, 60, 300, 900, 3600)  # wait after so many errors in a row


def error_class(text: Column | str) -> Column:
    """The class that an error's text tells, whatever its case; ``unknown`` for none, null and empty."""
    low = F.lower(col(text))
    any_of = lambda tests: reduce(lambda a, b: a | b, tests)
    told = {name: any_of([*[low.rlike("(?i)" + p) for p in patterns], *[low.contains(t) for t in texts]]) for name, (patterns, texts) in ERROR_CLASSES.items()}
    together = any_of([reduce(lambda a, b: a & b, [low.contains(t) for t in texts]) for texts in OVERFLOW_TOGETHER])
    told["context_overflow"] = (told["context_overflow"] | together) & ~any_of([low.contains(t) for t in NO_OVERFLOW])
    ladder = reduce(lambda acc, name: acc.when(told[name], name), told, F.when(F.coalesce(low, F.lit("")) == "", "unknown"))
    return ladder.otherwise("unknown")


def resolve_symbol(name: Column | str, coins=("BTC", "ETH", "SOL")) -> Column:
    """struct(market, symbol): pairs with a quote currency and known coins trade as crypto, all else as equity."""
    x = F.upper(F.trim(col(name)))
    base = F.regexp_extract(x, r"^([A-Z0-9]+)-USD$", 1)
    pair = x.rlike("^[A-Z0-9]{2,}(USDT|USDC|BUSD)$")
    crypto = pair | (base != "") | x.isin(*coins)
    symbol = F.when(pair, x).when(base != "", F.concat(base, F.lit("USDT"))).when(x.isin(*coins), F.concat(x, F.lit("USDT"))).otherwise(x)
    return F.struct(F.when(crypto, "crypto").otherwise("equity").alias("market"), symbol.alias("symbol"))


def since(shorthand: Column | str, now: Column) -> Column:
    """Lower time bound from 15m, 3h or 2d before now."""
    n, unit = F.regexp_extract(col(shorthand), r"^(\d+)([mhd])$", 1).try_cast("int"), F.regexp_extract(col(shorthand), r"^(\d+)([mhd])$", 2)
    seconds = n * F.when(unit == "m", 60).when(unit == "h", 3600).otherwise(86400)
    return F.timestamp_seconds(F.unix_timestamp(now) - seconds)


def active(ts: Column | str, days, start: str, end: str, zone: str = "UTC") -> Column:
    """Whether a UTC time lies on one of the weekdays (1 = Sunday) and between two HH:mm of the zone."""
    local = F.from_utc_timestamp(col(ts), zone)
    hhmm = F.date_format(local, "HH:mm")
    return F.dayofweek(local).isin(*days) & (hhmm >= start) & (hhmm <= end)


def next_run(anchor: Column, every: Column, now: Column) -> Column:
    """The first anchor + k x every after now."""
    n = anchor + F.ceil((now - anchor) / every) * every
    return F.when(n <= now, n + every).otherwise(n)


def backoff(errors: Column) -> Column:
    """Seconds to wait after so many errors in a row."""
    return F.when(errors <= 0, 0).otherwise(F.element_at(F.array(*[F.lit(b) for b in BACKOFF_SECONDS]), F.least(errors, F.lit(len(BACKOFF_SECONDS))).cast("int")))


def annualised(rate: Column, hours: Column | float) -> Column:
    """A rate per so many hours as percent a year."""
    return rounded(rate * 24 / hours * 365 * 100, 2)


def byte_size(n: Column | str) -> Column:
    """Bytes as B, KB or MB."""
    x = col(n)
    return F.when(x < 1024, F.format_string("%dB", x)).when(x < 1048576, F.format_string("%.1fKB", x / 1024)).otherwise(F.format_string("%.1fMB", x / 1048576))
