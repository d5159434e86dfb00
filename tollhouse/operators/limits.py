"""Rate limits and spend caps replayed over recorded traffic."""

from __future__ import annotations

import datetime as dt
import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tollhouse.operators.replay import replayed, stepped

ORDER = ("ts", "request_id")
EPOCH = dt.datetime(1970, 1, 1)


def _before(rows: DataFrame, amount: Column) -> DataFrame:
    """``rows`` (key_id, day, …) with __today and __month: ``amount`` of the key's earlier rows of the day, and of the month.

    The month is the sum of its earlier days, which are added up by day first, and of the
    day's own: a task sorts a day of a key at most.
    """
    day = W.partitionBy("key_id", "day").orderBy(*ORDER).rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("__amount", F.coalesce(amount, F.lit(0)).cast("long"))
    daily = rows.groupBy("key_id", "day").agg(F.sum("__amount").alias("__sum"))
    earlier = W.partitionBy("key_id", F.date_trunc("month", "day")).orderBy("day").rowsBetween(W.unboundedPreceding, -1)
    daily = daily.select(F.col("key_id").alias("__key"), F.col("day").alias("__of"), F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__days"))
    rows = rows.join(daily, rows.key_id.eqNullSafe(F.col("__key")) & rows.day.eqNullSafe(F.col("__of")))
    today = F.coalesce(F.sum("__amount").over(day), F.lit(0))
    return rows.withColumn("__today", today).withColumn("__month", F.col("__today") + F.col("__days")).drop("__amount", "__days", "__key", "__of")


def running_key_spend(cost: DataFrame) -> DataFrame:
    """``cost`` with what its key spent before it in the day and in the month."""
    return _before(cost, F.col("total_e4")).withColumnsRenamed({"__today": "prior_day_e4", "__month": "prior_month_e4"})


def spend_cap_replay(cost: DataFrame, keys: DataFrame) -> DataFrame:
    """``cost`` with blocked and reason: 'daily' before 'monthly', '' if admitted.

    A request is blocked once the cents spent before it, rounded up, reach the cap; blocked
    requests are not charged.  Spend only grows, so what a period blocks is a suffix of it
    and running sums are exact: by day over all requests, by month over those that the day
    admits, and, for the reason, by day once more over those that the month admits.
    """
    caps = keys.select("key_id", "daily_limit_cents", "monthly_limit_cents")
    rows = cost.join(caps, "key_id", "left").fillna(0, ["daily_limit_cents", "monthly_limit_cents"])
    full = lambda spent, cap: (F.col(cap) > 0) & (F.ceil(F.col(spent) / 100) >= F.col(cap))
    rows = _before(rows, F.col("total_e4")).withColumn("__full", full("__today", "daily_limit_cents")).drop("__today", "__month")
    rows = _before(rows, F.when(~F.col("__full"), F.col("total_e4"))).withColumn("__spent", full("__month", "monthly_limit_cents")).drop("__today", "__month")
    # Once the month is spent, the day's sum stands still: what the month blocks is never charged.
    day = W.partitionBy("key_id", "day").orderBy(*ORDER).rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("__charged", F.coalesce(F.sum(F.when(~F.col("__spent"), F.col("total_e4")).otherwise(0)).over(day), F.lit(0)))
    reason = F.when(full("__charged", "daily_limit_cents"), "daily").when(F.col("__spent"), "monthly").otherwise("")
    return rows.withColumn("reason", reason).withColumn("blocked", F.col("reason") != "").drop("__full", "__spent", "__charged")


class _Reserved:
    """What one period of a key has booked and in reserve; the reserve never falls below 0."""

    def __init__(self, cap_cents: int):
        self.cap, self.period, self.booked, self.reserved = cap_cents, None, 0, 0

    def at(self, period) -> _Reserved:
        if period != self.period:
            self.period, self.booked, self.reserved = period, 0, 0
        return self

    def reserve(self, estimate: int) -> bool:
        """Whether what is booked and in reserve leaves room; the estimate is then in reserve."""
        room = self.cap <= 0 or -(-(self.booked + self.reserved) // 100) < self.cap
        self.add(estimate if room and self.cap > 0 else 0)
        return room

    def add(self, change: int) -> None:
        self.reserved = max(0, self.reserved + change)


def spend_cap_reservation(attempts: DataFrame, keys: DataFrame, grace_s: int = 30) -> DataFrame:
    """Decisions of a daily and a monthly cap together on ``attempts`` (request_id, key_id, ts, est_e4, total_e4, done_ts).

    Gives allowed, reason ('daily', 'monthly' or '') and day_reserved_e4 and month_reserved_e4,
    what was in reserve before.  A request reserves its estimate with the day, then with the
    month; if the month has no room, the day's reservation is undone.  When it is done, its cost
    is booked and takes the estimate's place in the reserve, which it leaves ``grace_s`` seconds
    later.  Both happen to the day and month of that time: a reservation made before midnight
    and settled after stays with its day, and the new day's reserve never falls below 0.  One
    that is never done stays in reserve.  An estimate of 0 or less only reads what is booked.
    Caps of 0 or less are none, null amounts are 0, null keys a key of their own.

    Decisions of a key follow one another.  A key's log is cut where a month begins after
    all that came before has settled; each piece streams through a task that holds only
    what is still to settle.
    """
    caps = keys.select("key_id", "daily_limit_cents", "monthly_limit_cents")
    rows = attempts.join(caps, "key_id", "left").fillna(0, ["daily_limit_cents", "monthly_limit_cents", "est_e4", "total_e4"])
    rows = rows.withColumns({"ts": F.col("ts").cast("timestamp"), "done_ts": F.col("done_ts").cast("timestamp")})
    month = F.date_trunc("month", "ts")
    settled = F.coalesce(F.col("done_ts") + F.expr(f"INTERVAL {grace_s} SECONDS"), F.col("ts"))
    months = rows.groupBy("key_id", month.alias("__month")).agg(F.max(F.greatest(settled, "ts")).alias("__over"))
    of_key = W.partitionBy("key_id").orderBy("__month")
    cut = (F.max("__over").over(of_key.rowsBetween(W.unboundedPreceding, -1)) < F.col("__month")).cast("int")
    months = months.withColumn("__cut", F.coalesce(cut, F.lit(0))).withColumn("piece", F.sum("__cut").over(of_key)).select(F.col("key_id").alias("__key"), "__month", "piece")
    rows = rows.join(months, rows.key_id.eqNullSafe(F.col("__key")) & (month == F.col("__month")))
    micros = {c: F.unix_micros(c) for c in ("ts", "done_ts")}
    rows = rows.select("request_id", "key_id", "piece", *[F.coalesce(v, F.lit(-1)).alias(f"{c}_us") for c, v in micros.items()], "est_e4", "total_e4", "daily_limit_cents", "monthly_limit_cents")
    out = "request_id long, key_id string, allowed boolean, reason string, day_reserved_e4 long, month_reserved_e4 long"

    def fresh():
        day = month = None
        due: list[tuple] = []  # heap of (time, order, booked, change of the reserve)

        def periods(us: int) -> tuple[_Reserved, _Reserved]:
            now = EPOCH + dt.timedelta(microseconds=us)
            return day.at((now.year, now.month, now.day)), month.at((now.year, now.month))

        def decide(r) -> tuple:
            nonlocal day, month
            if day is None:
                day, month = _Reserved(r.daily_limit_cents), _Reserved(r.monthly_limit_cents)
            while due and due[0][0] <= r.ts_us:
                us, _, cost, change = heapq.heappop(due)
                for period in periods(us):
                    period.booked += cost
                    if period.cap > 0:
                        period.add(change)
            today, this_month = periods(r.ts_us)
            before = today.reserved, this_month.reserved
            estimate = max(0, r.est_e4)
            if estimate:
                reason = "" if today.reserve(estimate) else "daily"
                if not reason and not this_month.reserve(estimate):
                    reason = "monthly"
                    if today.cap > 0:
                        today.add(-estimate)
            else:
                full = [p.cap > 0 and -(-p.booked // 100) >= p.cap for p in (today, this_month)]
                reason = "daily" if full[0] else "monthly" if full[1] else ""
            if not reason and r.done_ts_us >= 0:
                heapq.heappush(due, (r.done_ts_us, r.request_id, r.total_e4, r.total_e4 - estimate if estimate else 0))
                heapq.heappush(due, (r.done_ts_us + grace_s * 1_000_000, r.request_id, 0, -r.total_e4 if estimate else 0))
            return r.request_id, r.key_id, not reason, reason, *before

        return decide

    return replayed(rows, ["key_id", "piece"], ["ts_us", "request_id"], fresh, out)


def scope_expand(df: DataFrame) -> DataFrame:
    """A row for each scope of a request: global, provider:, model:, key: and user:, empty ones left out."""
    named = [F.when(F.col(c) != "", F.struct(F.lit(k).alias("kind"), F.concat(F.lit(f"{k}:"), c).alias("scope_key"))) for k, c in (("provider", "provider"), ("model", "model"), ("key", "key_id"), ("user", "user_id"))]
    every = F.array_compact(F.array(F.struct(F.lit("global").alias("kind"), F.lit("global").alias("scope_key")), *named))
    return df.withColumn("__s", F.explode(every)).withColumns({"kind": F.col("__s.kind"), "scope_key": F.col("__s.scope_key")}).drop("__s")


def effective_limits(scopes: DataFrame, limits: DataFrame, overrides: DataFrame) -> DataFrame:
    """(scope_key, win, req_limit, tok_limit): the kind's limit under an override for the scope where that is positive."""
    base = scopes.select("kind", "scope_key").distinct().join(limits, "kind")
    own = overrides.select("scope_key", "win", F.col("req_limit").alias("__r"), F.col("tok_limit").alias("__t"))
    pick = lambda o, b: F.when(F.coalesce(F.col(o), F.lit(0)) > 0, F.col(o)).otherwise(F.col(b))
    return base.join(own, ["scope_key", "win"], "left").select("scope_key", "win", pick("__r", "req_limit").alias("req_limit"), pick("__t", "tok_limit").alias("tok_limit"))


def bucket(win: Column) -> Column:
    """Start of the UTC minute or day of ``ts``."""
    return F.when(win == "minute", F.date_trunc("minute", "ts")).otherwise(F.date_trunc("day", "ts"))


def rate_limit_usage(df: DataFrame, limits: DataFrame) -> DataFrame:
    """Requests and tokens per scope and window against the limit of the scope's kind; the metric exceeded, requests before tokens."""
    windows = scope_expand(df).join(limits, "kind").withColumn("bucket", bucket(F.col("win")))
    used = windows.groupBy("scope_key", "win", "bucket", "req_limit", "tok_limit").agg(F.count("*").alias("requests"), F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("tokens"))
    over = F.when((F.col("req_limit") > 0) & (F.col("requests") > F.col("req_limit")), "requests").when((F.col("tok_limit") > 0) & (F.col("tokens") > F.col("tok_limit")), "tokens").otherwise("")
    return used.withColumns({"remaining": F.greatest(F.lit(0), F.col("req_limit") - F.col("requests")), "metric": over})


def rate_limit_replay_requests(df: DataFrame, scope: str, per_minute: int, per_day: int) -> DataFrame:
    """``df`` with allowed and window for limits on requests alone in one kind of scope.

    Denied requests do not count, so a minute admits its first ``per_minute`` requests and a
    day the first ``per_day`` of those.
    """
    rows = df.filter(F.col(scope) != "")
    minute = W.partitionBy(scope, F.date_trunc("minute", "ts")).orderBy(*ORDER)
    rows = rows.withColumn("__m", F.row_number().over(minute) <= per_minute)
    day = W.partitionBy(scope, "day").orderBy(*ORDER).rowsBetween(W.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.col("__m").cast("long")).over(day), F.lit(0))
    rows = rows.withColumn("window", F.when(~F.col("__m"), "minute").when(before >= per_day, "day").otherwise(""))
    return rows.withColumn("allowed", F.col("window") == "").drop("__m")


def retry_after(ts: Column, win: Column) -> Column:
    """Seconds to the end of the UTC minute (60 at its start) or day."""
    seconds = F.unix_seconds(ts.cast("timestamp"))
    return F.when(win == "minute", 60 - seconds % 60).otherwise(86400 - seconds % 86400)


class Limiter:
    """Counters of one scope in its current minute and day; requests must not go back in time."""

    def __init__(self, rpm: int, tpm: int, rpd: int, tpd: int, first_free: bool = True):
        self.windows = (("minute", 60, rpm, tpm), ("day", 86_400, rpd, tpd))
        self.first_free = first_free
        self.used = [[-1, 0, 0], [-1, 0, 0]]  # number of the window, requests, tokens

    def check(self, seconds: int, tokens: int) -> tuple | None:
        """Metric, window, limit, what is left and seconds to wait, of the first limit that a request exceeds."""
        for (win, length, most_requests, most_tokens), used in zip(self.windows, self.used, strict=True):
            if used[0] != seconds // length:
                used[:] = seconds // length, 0, 0
            if most_requests > 0 and used[1] + 1 > most_requests:
                return "requests", win, most_requests, max(0, most_requests - used[1]), length - seconds % length
            if most_tokens > 0 and used[2] + tokens > most_tokens and not (self.first_free and used[2] == 0):
                return "tokens", win, most_tokens, max(0, most_tokens - used[2]), length - seconds % length
        return None

    def charge(self, tokens: int) -> None:
        for used in self.used:
            used[1] += 1
            used[2] += tokens

    def decide(self, seconds: int, tokens: int) -> tuple | None:
        """``check``, and the charge if nothing is exceeded."""
        denied = self.check(seconds, tokens)
        if denied is None:
            self.charge(tokens)
        return denied


def rate_limit_replay(df: DataFrame, scope: str, rpm: int, tpm: int, rpd: int, tpd: int, first_free: bool = True) -> DataFrame:
    """Decisions of a limiter of one kind of scope: allowed, metric, win, lim, remaining and retry_after.

    The minute is checked before the day and requests before tokens.  With ``first_free`` a
    window's first request with tokens passes whatever it asks for.  A large request may be
    denied and a smaller one after it admitted, so a scope's day is replayed in order.
    """
    rows = df.filter(F.col(scope) != "").select("request_id", "ts", "day", F.unix_seconds(F.col("ts").cast("timestamp")).alias("seconds"), F.col(scope).alias("scope"), (F.col("input_tokens") + F.col("output_tokens")).alias("tokens"))
    out = "request_id long, scope string, allowed boolean, metric string, win string, lim long, remaining long, retry_after long"

    def fresh():
        limiter = Limiter(rpm, tpm, rpd, tpd, first_free)

        def decide(r) -> tuple:
            denied = limiter.decide(r.seconds, r.tokens)
            return (r.request_id, r.scope, denied is None, *(denied or ("", "", 0, 0, 0)))

        return decide

    return replayed(rows, ["scope", "day"], [*ORDER], fresh, out)


_ADMITTED = "request_id long, ts timestamp, unit long, day date, provider string, model string, key_id string, user_id string, tokens long, allowed boolean, scope_key string, metric string, win string, lim long, retry_after long"
SCOPES = (("provider", "provider"), ("model", "model"), ("key", "key_id"), ("user", "user_id"))


def rate_limit_admission(df: DataFrame, limits: DataFrame, overrides: DataFrame, first_free: bool = True, unit_s: int = 60) -> DataFrame:
    """Decisions on ``df`` (request_id, ts, provider, model, key_id, user_id, input_tokens, output_tokens) by all its scopes together.

    ``limits`` and ``overrides`` are those of ``effective_limits``.  Scopes are checked in the order of
    ``scope_expand``, of each the minute before the day and requests before tokens; the first
    limit exceeded denies the request (scope_key, metric, win, lim, retry_after), and only a
    request that none denies is charged to all.  With ``first_free`` a window's first request
    with tokens passes whatever it asks for.  Empty and null members have no scope but
    ``global``, null tokens are 0.

    ``global`` couples all decisions of a day, but only by what the day has used so far.  So units of
    ``unit_s`` seconds (whole minutes that divide a day) are replayed side by side, each from
    assumed use of its scopes, at first none.  The use that follows from the decisions is
    summed by scope and unit and becomes the next assumption, until it is that which the
    decisions were taken with: then they are those of one pass in order.  Every round settles
    one more unit of a day at least, in practice a few rounds settle all; settled days are
    not replayed again.
    """
    if unit_s % 60 or 86_400 % unit_s:
        raise ValueError("unit_s must be whole minutes that divide a day")
    ts = F.col("ts").cast("timestamp")
    members = [F.coalesce(c, F.lit("")).alias(c) for _, c in SCOPES]
    tokens = F.coalesce("input_tokens", F.lit(0)) + F.coalesce("output_tokens", F.lit(0))
    rows = df.select("request_id", ts.alias("ts"), F.floor(F.unix_seconds(ts) / unit_s).cast("long").alias("unit"), F.to_date(ts).alias("day"), *members, tokens.cast("long").alias("tokens"))
    present = scope_expand(rows.select("unit", "day", *[c for _, c in SCOPES])).select("unit", "day", "kind", "scope_key").distinct()
    each = effective_limits(present, limits, overrides).groupBy("scope_key").agg(*[F.max(F.when(F.col("win") == w, F.col(c))).alias(n) for w, c, n in (("minute", "req_limit", "rpm"), ("minute", "tok_limit", "tpm"), ("day", "req_limit", "rpd"), ("day", "tok_limit", "tpd"))])
    scopes = present.drop("kind").join(each, "scope_key", "left").fillna(0, ["rpm", "tpm", "rpd", "tpd"])
    scopes = stepped(scopes.withColumns({"requests": F.lit(0).cast("long"), "used": F.lit(0).cast("long")}))
    decided = None
    while True:
        found = stepped(_units(rows, scopes, first_free))
        used = scope_expand(found.filter("allowed")).groupBy("unit", "scope_key").agg(F.count("*").alias("__r"), F.sum("tokens").alias("__t"))
        before = W.partitionBy("day", "scope_key").orderBy("unit").rowsBetween(W.unboundedPreceding, -1)
        sums = {n: F.coalesce(F.sum(F.coalesce(c, F.lit(0))).over(before), F.lit(0)) for n, c in (("__requests", "__r"), ("__used", "__t"))}
        after = stepped(scopes.join(used, ["unit", "scope_key"], "left").withColumns(sums).drop("__r", "__t"))
        open_days = after.filter("requests <> __requests OR used <> __used").select("day").distinct()
        settled = found.join(open_days, "day", "left_anti")
        decided = settled if decided is None else decided.unionByName(settled)
        if open_days.isEmpty():
            return decided.drop("unit", "day")
        rows = stepped(rows.join(open_days, "day", "left_semi"))
        scopes = after.join(open_days, "day", "left_semi").drop("requests", "used").withColumnsRenamed({"__requests": "requests", "__used": "used"})


def _units(rows: DataFrame, scopes: DataFrame, first_free: bool) -> DataFrame:
    """``_ADMITTED`` of ``rows``: each unit replayed from what ``scopes`` say its day has used."""

    def fresh():
        limiters: dict[str, Limiter] = {}

        def decide(r) -> tuple | None:
            seconds = r.us // 1_000_000
            if r.head:
                own = limiters[r.scope_key] = Limiter(r.rpm, r.tpm, r.rpd, r.tpd, first_free)
                own.used[1] = [seconds // 86_400, r.requests, r.used]
                return None
            names = ["global", *[f"{k}:{v}" for (k, _), v in zip(SCOPES, (r.provider, r.model, r.key_id, r.user_id), strict=True) if v]]
            denied, scope = None, ""
            for name in names:
                denied = limiters[name].check(seconds, r.tokens)
                if denied:
                    scope = name
                    break
            else:
                for name in names:
                    limiters[name].charge(r.tokens)
            metric, win, lim, _, wait = denied or ("", "", 0, 0, 0)
            return r.request_id, r.ts, r.unit, r.day, r.provider, r.model, r.key_id, r.user_id, r.tokens, not scope, scope, metric, win, lim, wait

        return decide

    heads = scopes.withColumns({"head": F.lit(True), "us": F.unix_micros(F.col("day").cast("timestamp"))})
    both = rows.withColumns({"head": F.lit(False), "us": F.unix_micros("ts")}).unionByName(heads, allowMissingColumns=True)
    counts = ["rpm", "tpm", "rpd", "tpd", "requests", "used", "tokens", "request_id"]
    # Ids and counts that a kind of row has not are 0, so that all stay whole numbers in pandas.
    both = both.withColumns({c: F.coalesce(c, F.lit(0)) for c in counts}).withColumn("last", F.when(F.col("head"), F.lit(-1)).otherwise(F.col("us")))
    return replayed(both, ["unit"], ["last", "request_id"], fresh, _ADMITTED)


def rate_limit_daily(decisions: DataFrame) -> DataFrame:
    """(day, by, member, total, allowed, blocked): all decisions under an empty ``by``; by provider and by reason (metric and window) blocked ones alone."""
    blocked = F.count(F.when(~F.col("allowed"), 1)).alias("blocked")
    whole = decisions.groupBy("day").agg(F.count("*").alias("total"), F.count(F.when(F.col("allowed"), 1)).alias("allowed"), blocked).withColumns({"by": F.lit(""), "member": F.lit("")})
    denied = decisions.filter("NOT allowed")
    out = whole
    for by, member in (("provider", F.col("provider")), ("reason", F.concat_ws(" per ", "metric", "win"))):
        part = denied.groupBy("day", member.alias("member")).agg(F.count("*").alias("blocked")).withColumns({"by": F.lit(by), "total": F.lit(0).cast("long"), "allowed": F.lit(0).cast("long")})
        out = out.unionByName(part)
    return out.select("day", "by", "member", "total", "allowed", "blocked")


def rate_limit_reconcile(df: DataFrame, scope: str) -> DataFrame:
    """Corrected counters per scope and minute from rows (ts, done_ts, est_tokens, actual_tokens, status).

    The difference of actual and estimated tokens counts if the window is still the same; a
    server fault without tokens takes request and estimate back; counters end at 0 at least.
    """
    same = F.date_trunc("minute", "ts") == F.date_trunc("minute", "done_ts")
    fault = (F.col("status") >= 500) & (F.col("actual_tokens") <= 0)
    tokens = F.when(same & fault, 0).when(same, F.col("actual_tokens")).otherwise(F.col("est_tokens"))
    return df.filter(F.col(scope) != "").groupBy(scope, F.date_trunc("minute", "ts").alias("bucket")).agg(
        F.greatest(F.lit(0), F.sum(F.when(same & fault, 0).otherwise(1))).alias("requests"), F.greatest(F.lit(0), F.sum(tokens)).alias("tokens")
    )
