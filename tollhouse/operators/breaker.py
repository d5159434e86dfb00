"""Circuit breakers of providers and their models, replayed over recorded attempts.

A request meets three breakers: that of its provider and model, that of the bare provider
(opened by an exhausted quota) and the provider's rollup (open while enough different keys have
opened lately).  They depend on each other, so decisions of a provider follow one
another.  Most requests change nothing, though: only failures and the first requests after a
cooldown do.  Those alone are replayed in order; all others read the breakers as the last
replayed request before them left them, in windows of a bounded stretch of time.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tollhouse.operators.replay import replayed

SECOND = 1_000_000
#: Replayed requests after which idle keys are dropped from memory.
FORGET = 10_000
DEGRADED, QUOTA = "provider_degraded", "insufficient_quota"
CLOSED, OPEN, HALF_OPEN = "closed", "open", "half_open"


class Breakers:
    """The breakers of one provider; times are microseconds and must not go back."""

    def __init__(self, provider: str, threshold: int, window_s: int, cooldown_s: int, mode: str, rollup_threshold: int, rollup_window_s: int):
        self.provider, self.threshold, self.enforce = provider, threshold, mode == "enforce"
        self.window, self.cooldown = window_s * SECOND, cooldown_s * SECOND
        self.rollup_threshold, self.rollup_window = rollup_threshold, max(0, rollup_window_s) * SECOND
        self.keys: dict[str, list] = {}  # state, open until, times of failures
        self.opened: dict[str, int] = {}  # latest opening of keys that have not recovered

    def key(self, model: str) -> str:
        return f"{self.provider}:{model}" if model else self.provider

    def at(self, key: str, now: int) -> list:
        """The breaker of a key; once its cooldown is over it is half open."""
        own = self.keys.setdefault(key, [CLOSED, 0, deque()])
        if own[0] == OPEN and now > own[1]:
            own[0] = HALF_OPEN
        return own

    def rollup_until(self) -> int:
        """Until when the rollup stays open as things are; 0: it is not open."""
        if not 0 < self.rollup_threshold <= len(self.opened) or not self.rollup_window:
            return 0
        return sorted(self.opened.values())[-self.rollup_threshold] + self.rollup_window

    def _open(self, key: str, now: int) -> None:
        self.keys[key][:2] = OPEN, now + self.cooldown

    def _fail(self, key: str, now: int) -> int:
        failures = self.at(key, now)[2]
        failures.append(now)
        while failures[0] <= now - self.window:
            failures.popleft()
        return len(failures)

    def decide(self, now: int, model: str, failure_class: str, aborted: bool) -> tuple[str, str, str, bool]:
        """(state before, action, key that decided, whether a breaker opened) of the next request."""
        key = self.key(model)
        own = self.at(key, now)
        state, by = own[0], key
        if self.enforce and state == CLOSED and key != self.provider:
            whole = self.at(self.provider, now)
            if whole[0] != CLOSED:
                state, by = whole[0], self.provider
        rolled = now < self.rollup_until()
        if self.enforce:
            if state == OPEN or (state == CLOSED and rolled):
                return OPEN, "fast_fail", by, False
            if state == HALF_OPEN:
                return state, *self._probe(by, now, failure_class, aborted)
        failing = not self.enforce and (state == OPEN or rolled)
        action, opens = "would_fail" if failing else "pass", False
        if not aborted and failure_class == DEGRADED:
            if self._fail(key, now) >= self.threshold and own[0] == CLOSED:
                self._open(key, now)
                self.opened[key] = now
                action, opens = action if failing else "opened", True
        elif not aborted and failure_class == QUOTA and self.enforce:
            self._fail(self.provider, now)
            self._open(self.provider, now)
            action, by, opens = "forced_open", self.provider, True
        return state, action, by, opens

    def _probe(self, key: str, now: int, failure_class: str, aborted: bool) -> tuple[str, str, bool]:
        if aborted:
            return "probe", key, False
        if failure_class == "none":
            self.keys[key] = [CLOSED, 0, deque()]
            self.opened.pop(key, None)
            return "probe_closed", key, False
        self._open(key, now)
        self.opened[key] = now
        return "probe_reopened", key, True

    def dump(self) -> dict:
        """What there is to remember, as JSON."""
        return {"keys": {k: [s, u, list(f)] for k, (s, u, f) in self.keys.items()}, "opened": self.opened}

    def load(self, memory: dict) -> None:
        self.keys = {k: [s, u, deque(f)] for k, (s, u, f) in memory["keys"].items()}
        self.opened = dict(memory["opened"])

    def forget(self, now: int) -> None:
        """Drops what can no longer matter: openings beyond the rollup's window, closed keys without late failures."""
        self.opened = {k: t for k, t in self.opened.items() if t > now - self.rollup_window}
        idle = [k for k, (state, _, failures) in self.keys.items() if state == CLOSED and (not failures or failures[-1] <= now - self.window)]
        for k in idle:
            del self.keys[k]


_OUT = "request_id long, ts timestamp, us long, bucket long, provider string, model string, state_before string, action string, key string, opens boolean, own_state string, own_until long, whole_state string, whole_until long, rolled_until long"
COLUMNS = ("request_id", "ts", "provider", "model", "state_before", "action", "key", "opens")


def _marked(rows: DataFrame, live: DataFrame, hot: DataFrame, cooldown_s: int, probes: bool) -> DataFrame:
    """``rows`` of live providers with active: whether a request may change a breaker or is its key's first of a bucket.

    Besides failures, the next request of a key after the end of a cooldown is active.  Any
    failure of the key may begin one; where quotas run out, any failure of its provider.
    """
    rows = rows.join(live, "provider")
    counts = F.col("failure_class").isin(DEGRADED, QUOTA) & ~F.col("aborted")
    first = F.row_number().over(W.partitionBy("provider", "bucket", "model").orderBy("us", "request_id")) == 1
    if not probes:
        return rows.withColumn("active", counts | first)
    failed = rows.filter((F.col("failure_class") != "none") & ~F.col("aborted"))
    own = failed.filter("NOT quota").join(hot, ["provider", "model"], "left_semi")
    ends = failed.filter("quota").withColumn("mark", F.lit(1)).unionByName(own.withColumn("mark", F.lit(2)))
    length = F.col("bucket_us")
    ends = ends.withColumn("us", F.col("us") + cooldown_s * SECOND).withColumn("bucket", F.floor(F.col("us") / length).cast("long"))
    both = rows.withColumn("mark", F.lit(0)).unionByName(ends)
    # A request at the very end of a cooldown still finds the breaker open.
    order = ("us", F.col("mark") > 0)
    before = lambda mark, w: F.count(F.when(F.col("mark") == mark, 1)).over(w.orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    both = both.withColumn("__p", before(1, W.partitionBy("provider", "bucket")))
    both = both.withColumn("__k", before(2, W.partitionBy("provider", "bucket", "model"))).filter("mark = 0")
    sent = W.partitionBy("provider", "bucket", "model", "aborted").orderBy("us", "request_id")
    last = F.lag(F.struct("__p", "__k")).over(sent)
    both = both.withColumn("active", ~F.col("aborted") & ~last.eqNullSafe(F.struct("__p", "__k")))
    # Behind a probe of its own breaker a key may send the one that its provider waits for.
    again = ~F.col("aborted") & F.lag("active").over(sent)
    return both.withColumn("active", F.col("active") | again | counts | first).drop("mark", "__p", "__k")


def breaker_replay(
    attempts: DataFrame, threshold: int = 5, window_s: int = 120, cooldown_s: int = 300, mode: str = "enforce", rollup_threshold: int = 0, rollup_window_s: int = 300, bucket_s: int = 3600
) -> DataFrame:
    """What the breakers answer to every attempt (request_id, ts, provider, model, failure_class, aborted).

    ``COLUMNS`` of the result: the state that the request met, the action, the ``key`` (provider:model,
    or the provider alone) that decided, and whether it opened a breaker.

    Closed, a key counts degraded failures within the window and opens at the threshold.  An
    exhausted quota opens the provider's own breaker at once, which holds for all its models
    whose own breaker is closed.  Open, requests fail fast and their outcomes do not count.
    Strictly after the cooldown the next request is a probe of the breaker it meets: it closes
    it and clears failures, opens it again, or, if aborted, changes nothing.  With
    ``rollup_threshold`` above 0, requests of closed keys also fail fast while so many keys have
    opened within ``rollup_window_s`` and not recovered.  In ``log`` mode nothing is blocked, no
    probe is sent and quotas do not count; an open key stays half open after its cooldown.

    Null providers and models count as empty (an empty model is the provider's own key), null
    classes as none.  Requests at one time follow by id.  Stretches of ``bucket_s`` are the
    unit that one task sorts, and cost only.
    """
    bucket = F.lit(bucket_s * SECOND).cast("long")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = attempts.select(
        "request_id", F.col("ts").cast("timestamp").alias("ts"), us.alias("us"), bucket.alias("bucket_us"), F.floor(us / bucket).cast("long").alias("bucket"),
        *[F.coalesce(c, F.lit(x)).alias(c) for c, x in (("provider", ""), ("model", ""), ("failure_class", "none"), ("aborted", False))],
    )
    enforce = mode == "enforce"
    counted = rows.filter(~F.col("aborted") & F.col("failure_class").isin(DEGRADED, *([QUOTA] if enforce else [])))
    quota = F.col("failure_class") == QUOTA
    stats = counted.groupBy("provider", "model").agg((F.count(F.when(~quota, 1)) >= threshold).alias("hot"), F.max(quota).alias("quota"))
    # A key without a model is the provider's own: its failures too open that one.
    whole = F.max(F.col("quota") | (F.col("hot") & (F.col("model") == "")))
    live = stats.groupBy("provider").agg(F.max("hot").alias("hot"), whole.alias("quota")).filter("hot OR quota").select("provider", "quota")
    hot = stats.filter("hot").select("provider", "model")
    calm = rows.join(live, "provider", "left_anti").withColumns({"state_before": F.lit(CLOSED), "action": F.lit("pass"), "key": _key(), "opens": F.lit(False)})
    marked = _marked(rows, live, hot, cooldown_s, enforce)

    def fresh():
        found, seen = None, 0

        def decide(r) -> tuple:
            nonlocal found, seen
            seen += 1
            if found is not None and seen % FORGET == 0:
                found.forget(r.us)
            if found is None:
                found = Breakers(r.provider, threshold, window_s, cooldown_s, mode, rollup_threshold, rollup_window_s)
            said = found.decide(r.us, r.model, r.failure_class, r.aborted)
            own, whole = found.at(found.key(r.model), r.us), found.at(r.provider, r.us)
            return r.request_id, r.ts, r.us, r.bucket, r.provider, r.model, *said, own[0], own[1], whole[0], whole[1], found.rollup_until()

        return decide

    active = marked.filter("active").select("request_id", "ts", "us", "bucket", "provider", "model", "failure_class", "aborted")
    decided = replayed(active, ["provider"], ["us", "request_id"], fresh, _OUT, ["bucket"])
    passive = marked.filter("NOT active").select("request_id", "ts", "us", "bucket", "provider", "model")
    return calm.select(*COLUMNS).unionByName(_answered(decided.unionByName(passive, allowMissingColumns=True), enforce).select(*COLUMNS))


def _key() -> Column:
    return F.when(F.col("model") == "", F.col("provider")).otherwise(F.concat_ws(":", "provider", "model"))


def _answered(rows: DataFrame, enforce: bool) -> DataFrame:
    """Rows without an action answered by the breakers as the last row with one left them."""
    last = lambda c, *by: F.last(c, ignorenulls=True).over(W.partitionBy("provider", "bucket", *by).orderBy("us", "request_id").rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumns({f"__{c}": last(c) for c in ("whole_state", "whole_until", "rolled_until")})
    rows = rows.withColumns({f"__{c}": last(c, "model") for c in ("own_state", "own_until")})
    now = lambda name: F.when((F.col(f"__{name}_state") == OPEN) & (F.col("us") > F.col(f"__{name}_until")), HALF_OPEN).otherwise(F.col(f"__{name}_state"))
    rows = rows.withColumns({"__whole": now("whole")}).withColumn("__own", F.when(F.col("model") == "", F.col("__whole")).otherwise(now("own")))
    rolled = F.col("us") < F.col("__rolled_until")
    if enforce:
        by_whole = (F.col("__own") == CLOSED) & (F.col("__whole") != CLOSED)
        state = F.when(by_whole, F.col("__whole")).when((F.col("__own") == CLOSED) & rolled, OPEN).otherwise(F.col("__own"))
        key = F.when(by_whole, F.col("provider")).otherwise(_key())
        action = F.when(state == OPEN, "fast_fail").when(state == HALF_OPEN, "probe").otherwise("pass")
    else:
        state, key = F.col("__own"), _key()
        action = F.when((state == OPEN) | rolled, "would_fail").otherwise("pass")
    waits = F.col("action").isNull()
    rows = rows.withColumns({"__state": state, "__key": key, "__action": action})
    return rows.withColumns({c: F.when(waits, F.col(x)).otherwise(F.col(c)) for c, x in (("state_before", "__state"), ("key", "__key"))} | {"opens": F.coalesce("opens", F.lit(False)), "action": F.coalesce("action", "__action")})


def breaker_events(replayed: DataFrame) -> DataFrame:
    """Circuit activity of a replay: what each request did to the breaker that decided, or how that one treated it."""
    return replayed.filter("action <> 'pass'").select("request_id", "ts", "provider", "key", F.col("action").alias("kind"))


#: Counts of circuit activity and the actions that each counts; none: all attempts.
ACTIVITY = {
    "checks_total": (),
    "blocked_open": ("fast_fail",),
    "probes_started": ("probe", "probe_closed", "probe_reopened"),
    "probes_succeeded": ("probe_closed",),
    "probes_failed": ("probe_reopened",),
    "circuits_opened": ("opened", "forced_open"),
}


def circuit_activity_daily(replayed: DataFrame) -> DataFrame:
    """(day, provider, ``ACTIVITY``) of a replay: each provider's counts, and those of all under an empty provider."""
    counts = [F.count(F.when(F.col("action").isin(*actions), 1) if actions else "*").alias(name) for name, actions in ACTIVITY.items()]
    daily = replayed.groupBy(F.to_date("ts").alias("day"), "provider").agg(*counts)
    return daily.unionByName(daily.groupBy("day").agg(*[F.sum(n).alias(n) for n in ACTIVITY]).withColumn("provider", F.lit("")))


def circuit_blocked_daily(replayed: DataFrame) -> DataFrame:
    """(day, key, blocked): requests that failed fast, by the breaker that was open."""
    return replayed.filter("action = 'fast_fail'").groupBy(F.to_date("ts").alias("day"), "key").agg(F.count("*").alias("blocked"))


def log_mode_counterfactual(attempts: DataFrame, **options) -> DataFrame:
    """(day, key, would_have_fast_failed) if breakers had only watched."""
    seen = breaker_replay(attempts, mode="log", **options).filter("action = 'would_fail'")
    return seen.groupBy(F.to_date("ts").alias("day"), "key").agg(F.count("*").alias("would_have_fast_failed"))
