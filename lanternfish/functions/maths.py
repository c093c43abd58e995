"""Numeric functions: Column -> Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sigmoid(cosine: Column, scale: float, bias: float) -> Column:
    """Calibrated logistic of a cosine, its argument kept within 60."""
    return 1 / (1 + F.exp(-F.greatest(F.lit(-60.0), F.least(F.lit(60.0), cosine * scale + bias))))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """The vector of length 1; null for a zero vector or one that is not finite."""
    norm = F.sqrt(dot(v, v))
    return F.when((norm > 0) & (norm < float("inf")), F.transform(v, lambda x: x.cast("double") / norm))


def is_valid(vec: Column, size: int) -> Column:
    """The given number of finite numbers, not all of them zero; false for null."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vec.isNotNull() & (F.size(vec) == size) & finite & F.exists(vec, lambda x: x != 0), F.lit(False))


def backoff(attempt: Column, cap: float, base: int = 0) -> Column:
    return F.least(F.pow(F.lit(2.0), attempt + base), F.lit(cap))


def retry_at(header: Column, now: Column, default: float = 60.0) -> Column:
    """When to try again: after the seconds of the header, or at its HTTP date, never before now; else after the default."""
    seconds = header.try_cast("double")
    at = F.unix_timestamp(F.try_to_timestamp(F.regexp_replace(F.regexp_replace(header, "^[A-Za-z]{3}, ", ""), " GMT$", ""), F.lit("dd MMM yyyy HH:mm:ss"))).cast("double")
    return F.when(seconds.isNotNull(), now + F.greatest(F.lit(0.0), seconds)).when(at.isNotNull(), F.greatest(now, at)).otherwise(now + default)


def request_interval(headers: Column, least: float = 2 / 3, default: float = 3.3) -> Column:
    """Seconds between requests that the advertised burst limits a minute allow, with a tenth of headroom."""
    burst = F.map_filter(headers, lambda k, v: k.startswith("x-ratelimit-limit-") & k.contains("burst") & v.rlike("^[0-9]*[1-9][0-9]*/min$"))
    each = F.transform(F.map_values(burst), lambda v: 60 / F.regexp_extract(v, "^([0-9]+)", 1).cast("double") * 1.1)
    return F.when(F.size(each) > 0, F.greatest(F.lit(least), F.array_max(each))).otherwise(default)


def progress(done: Column, target: Column, per_minute: Column) -> dict[str, Column]:
    """Remaining, percentage and minutes to go; the last is null without a pace."""
    left = F.greatest(target - done, F.lit(0))
    return {"remaining": left, "pct": F.round(F.least(F.lit(100.0), F.try_divide(100.0 * done, target)), 2), "eta_minutes": F.when(per_minute > 0, F.round(F.try_divide(left, per_minute), 2))}


def retry_delay(header: Column, attempt: Column, cap: float = 120.0) -> Column:
    """Seconds to wait: what the header asks for, else two to the power of the attempts and one, at most the cap."""
    return F.least(F.coalesce(header.try_cast("double"), F.pow(F.lit(2.0), attempt + 1)), F.lit(cap))


#: Seconds before each retry of a write to the index.
RETRY_DELAYS = (2, 4, 8, 16, 32, 60)


def listed_delay(attempt: Column, delays: tuple[int, ...] = RETRY_DELAYS) -> Column:
    """The delay before retry ``attempt`` (from 0); null when the list is spent and the error stands."""
    return F.get(F.array(*[F.lit(d) for d in delays]), attempt)


def transient_status(status: Column, transport: Column) -> Column:
    """A connection that broke, or a status that says to try again: worth another try."""
    return F.coalesce(transport, F.lit(False)) | F.coalesce((status >= 500) | (status == 429), F.lit(False))


# Codes with which a wiki's interface says that its backend is busy.
BUSY_CODES = ("maxlag", "ratelimited", "readonly", "cirrussearch-too-busy-error")


def transient_code(code: Column) -> Column:
    """A code of a busy backend, or an internal error; null and '' are none."""
    return F.coalesce(code.isin(*BUSY_CODES) | code.startswith("internal_api_error"), F.lit(False))


def goal_met(size: Column, stop_at: Column) -> Column:
    """The whole collection holds as many rows as it is to; 0 sets no goal."""
    return (stop_at > 0) & (size >= stop_at)


def pending_count(no_embed: Column, no_archive: Column, manifest: Column, points: Column, archived: Column) -> Column:
    """What a flush would write: manifest rows when nothing is embedded, points when nothing is archived, else what waits for the archive."""
    return F.when(no_embed, manifest).when(no_archive, points).otherwise(archived)


def flush_every(no_embed: Column, no_archive: Column, archived: int = 500, bare: int = 4_000) -> Column:
    """Rows between flushes: ``bare`` where rows are embedded and archived in one go, ``archived`` in all other modes."""
    return F.when(~no_embed & ~no_archive, bare).otherwise(archived)


def stop_reason(done: Column, target: Column, size: Column, goal: Column, elapsed: Column, seconds: Column, dry_polls: Column, most_dry: int = 3) -> Column:
    """Why a worker stops, the first that holds: its target, the goal of all, its time, a queue that was empty several times; null if it goes on."""
    return F.when(done >= target, "target").when(goal_met(size, goal), "goal").when(elapsed >= seconds, "time").when(dry_polls >= most_dry, "dry")


def coupled_rate(a: Column, b: Column) -> dict[str, Column]:
    """Items a unit of time of two coupled steps: the slower one's when they overlap, the harmonic sum when each waits for the other."""
    return {"overlapped": F.least(a, b), "serialised": F.try_divide(F.lit(1.0), F.try_divide(F.lit(1.0), a) + F.try_divide(F.lit(1.0), b))}


def projected(base: Column, value: Column, n: Column, to: float) -> Column:
    """A size measured at n rows, at ``to`` rows: what was there before any row stays, the rest grows in proportion."""
    return base + F.try_divide((value - base) * to, n)


def exit_code(done: Column, target: Column, queued: Column, goal_met: Column) -> Column:
    """75 asks for another run: short of the target, jobs left and the goal of all not met."""
    return F.when(~goal_met & (done < target) & (queued > 0), 75).otherwise(0)
