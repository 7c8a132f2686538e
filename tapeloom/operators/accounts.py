"""Accounts folded from their fills, as prefix operations instead of a loop over each account.

Between two closes of an account's symbol the position is a segment: it begins flat, and its quantity, average price and fees
are sums over it. What a segment yields when it is closed depends on nothing outside it, so cash, equity, its peak, the P&L of
the day and the week and the streak of losses are prefix sums, maxima and last values over the account. They run inside pieces of a day of
SLICE rows at most, so that an account with most of all fills is many tasks; what a piece inherits comes from tables of one
row per piece (and symbol). Rows are shuffled three times: for the segments, for the account's sums, for its peaks and starts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.lineage import cut
from tapeloom.operators.series import SLICE, pieces

#: Days from the epoch (a Thursday) to the first Monday, backwards.
TO_MONDAY = 3
PIECE = ("account", "_d", "_sub")


def _plus(a: Column, b: Column) -> Column:
    return F.when(a.isNull() & b.isNull(), None).otherwise(F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))


def _left_open(tails: DataFrame, outputs: dict[str, Callable]) -> DataFrame:
    """For every piece of an account's symbol, as _b columns, what the segment that is open at its start has gathered: tails
    are what comes after the last of a piece's closes, of which there are _all."""
    along = Window.partitionBy("account", "_sym").orderBy("_d", "_sub")
    t = tails.withColumn("_seg", F.sum((F.col("_all") > 0).cast("long")).over(along))
    same = Window.partitionBy("account", "_sym", "_seg").orderBy("_d", "_sub").rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumns({n: f(F.col(n)).over(same) for n, f in outputs.items()})
    return t.select(*PIECE, "_sym", "_all", *(F.lag(n).over(along).alias(f"_b{n}") for n in outputs))


def accounts(fills: DataFrame, initial: float = 10_000.0, baseline: DataFrame | None = None, size: int = SLICE) -> DataFrame:
    """The state of every account after each of its rows (account, fill_id, ts, symbol, kind, side, qty, price, fee), by ts and
    fill_id: position, avg_price, realised, cash, unrealised, equity, peak, drawdown, daily_pnl_pct, weekly_pnl_pct,
    loss_streak.

    kind 'open' begins a position of side +1 or -1 or averages into the one there is (whose side stays) and pays its fee from
    cash. 'close' ends the position at price: realised P&L is what it moved less its entry fees and the closing fee, and a loss
    lengthens the streak; a close of nothing changes nothing. 'mark' sets the price of a position, from which alone its
    unrealised P&L follows. 'sync' takes over price as the account's equity. Equity is cash and what is unrealised; its peak
    is looked at after marks and syncs, and at closes while the position still counts with its last mark; drawdown is the
    share (0 or more) that is missing to it. Realised P&L is
    counted from the first open or close of a UTC day and of a week from Monday on; the day's, with what is unrealised, is a
    share of the equity before that row, the week's of the initial equity.

    baseline (account, equity): the first authoritative equity of an account, which replaces `initial` as initial equity, peak
    and start of the day, but not as cash; missing, non-finite and non-positive ones don't. Null accounts or times are left out.
    """
    kind, is_ = F.col("kind"), lambda k: F.col("kind") == k
    d = fills.where(F.col("account").isNotNull() & F.col("ts").isNotNull()).select("account", "fill_id", "ts", "symbol", "kind", "side", "qty", "price", "fee")
    d = pieces(d, "account", "ts", ("fill_id", "kind", "symbol", "price"), size)
    fee, upto = F.coalesce("fee", F.lit(0.0)), (Window.unboundedPreceding, 0)

    # sums over the part of a segment that lies in its piece, and what a piece's first segment of a symbol inherits
    along = Window.partitionBy(*PIECE, "_sym").orderBy("_in")
    d = d.withColumns({"_sym": F.coalesce("symbol", F.lit("")), "_closes": F.coalesce(is_("close"), F.lit(False)).cast("int")})
    d = d.withColumns({"_n": F.coalesce(F.sum("_closes").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "_end": F.lead("_in").over(along).isNull()})
    inside, opens = Window.partitionBy(*PIECE, "_sym", "_n").orderBy("_in"), lambda x: F.when(is_("open"), x)
    sums = {"_q": F.sum(opens(F.col("qty"))), "_pq": F.sum(opens(F.col("qty") * F.col("price"))), "_fees": F.sum(opens(fee)), "_head": F.first(opens(F.struct("side")), ignorenulls=True)}
    d = d.withColumns({n: c.over(inside.rowsBetween(*upto)) for n, c in sums.items()})
    d = cut(d.select(*PIECE, "_in", "fill_id", "ts", "symbol", "kind", "price", fee.alias("fee"), "_sym", "_closes", "_n", "_end", *sums), "segments")
    tails = d.where("_end").select(*PIECE, "_sym", (F.col("_n") + F.col("_closes")).alias("_all"), *(F.when(F.col("_closes") == 0, F.col(n)).alias(n) for n in sums))
    left_open = _left_open(tails, {"_q": F.sum, "_pq": F.sum, "_fees": F.sum, "_head": lambda c: F.first(c, ignorenulls=True)})

    def moved(x: DataFrame, inherited: DataFrame) -> DataFrame:
        """Rows with their position, average price and what the position has moved."""
        x = x.join(inherited, [*PIECE, "_sym"])
        first = lambda n: F.when(F.col("_n") == 0, F.col(f"_b{n}"))
        x = x.withColumns({**{n: _plus(F.col(n), first(n)) for n in ("_q", "_pq", "_fees")}, "_head": F.coalesce(first("_head"), "_head")})
        held, avg = F.coalesce("_q", F.lit(0.0)) > 0, F.col("_pq") / F.col("_q")
        return x.withColumns({"_held": held, "_avg": F.when(held, avg), "_move": F.when(held, F.col("_head.side") * (F.col("price") - avg) * F.col("_q"))})

    left_open = cut(left_open, "open-segments")
    marks = moved(d.where(is_("mark")), left_open).where((F.col("_n") == F.col("_all")) & F.col("_move").isNotNull())
    marks = tails.select(*PIECE, "_sym", "_all").join(marks.groupBy(*PIECE, "_sym").agg(F.max_by("_move", "_in").alias("_was")), [*PIECE, "_sym"], "left")
    marks = _left_open(marks, {"_was": lambda c: F.last(c, ignorenulls=True)}).drop("_all")
    d = moved(d, cut(left_open.join(marks, [*PIECE, "_sym"]), "open-marks")).repartition(*PIECE)  # else once for segments, once for accounts
    marked = F.last(F.when(is_("mark"), F.col("_move")), ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, -1))
    d = d.withColumn("_was", F.coalesce(marked, F.when(F.col("_n") == 0, F.col("_b_was"))))

    # what each row adds to the account, and its sums in the piece
    ends, was = is_("close") & F.col("_held"), F.coalesce("_was", F.lit(0.0))
    realised = F.when(ends, F.col("_move") - F.col("_fees") - F.col("fee"))
    paid = F.when(is_("open"), -F.col("fee")).when(ends, F.col("_move") - F.col("fee")).otherwise(0.0)
    floats = F.when(is_("mark") & F.col("_held"), F.col("_move") - was).when(is_("close"), -was).otherwise(0.0)
    day = F.when(is_("open") | is_("close"), F.col("_d"))
    open_ = F.col("_held") & ~is_("close")
    finite = F.col("price").isNotNull() & ~F.isnan("price") & (F.abs("price") < float("inf"))
    d = d.select(
        *PIECE, "_in", "fill_id", "ts", "symbol", "kind", "price", "_held", F.when(open_, F.col("_q")).otherwise(0.0).alias("position"), F.when(open_, F.col("_avg")).alias("avg_price"),
        F.coalesce(realised, F.lit(0.0)).alias("_real"), paid.alias("_paid"), floats.alias("_float"), F.coalesce(realised < 0, F.lit(False)).cast("long").alias("_lost"), day.alias("_day"), (ends & (realised >= 0)).alias("_won"), (is_("sync") & finite).alias("_syncs"),
    )
    along = Window.partitionBy(*PIECE).orderBy("_in")
    so_far, earlier = along.rowsBetween(*upto), along.rowsBetween(Window.unboundedPreceding, -1)
    sums = {"_cash": "_paid", "unrealised": "_float", "_reals": "_real", "_losses": "_lost"}
    d = d.withColumns({**{n: F.sum(c).over(so_far) for n, c in sums.items()}, "_dayp": F.last("_day", ignorenulls=True).over(earlier), "_end": F.lead("_in").over(along).isNull()})
    sync = F.when(F.col("_syncs"), F.struct("price", "unrealised", "_cash"))
    d = d.withColumns({"_sy": F.last(sync, ignorenulls=True).over(so_far), "_syp": F.last(sync, ignorenulls=True).over(earlier), "_clean": F.last(F.when(F.col("_won"), F.col("_losses")), ignorenulls=True).over(so_far)})
    d = cut(d.drop("price", "_lost", "_won"), "steps")

    # what a piece inherits of the account; a sync's share of cash follows from the sums up to it
    before = Window.partitionBy("account").orderBy("_d", "_sub").rowsBetween(Window.unboundedPreceding, -1)
    latest = lambda c: F.last(c, ignorenulls=True)
    adjusted = lambda s: F.when(F.col(s).isNotNull(), F.col(f"{s}.price") - _plus(F.col(f"{s}.unrealised"), F.col("_bunrealised")) - _plus(F.col(f"{s}._cash"), F.col("_b_cash")))
    ahead = d.where("_end").select(*PIECE, *sums, F.coalesce("_day", "_dayp").alias("_dayp"), "_sy", "_clean")
    ahead = ahead.withColumns({**{f"_b{n}": F.sum(n).over(before) for n in sums}, "_b_dayp": latest("_dayp").over(before)})
    ahead = ahead.withColumns({"_b_adj": latest(adjusted("_sy")).over(before), "_b_clean": latest(F.col("_clean") + F.coalesce("_b_losses", F.lit(0))).over(before)})
    d = d.join(cut(ahead.select(*PIECE, *(f"_b{n}" for n in sums), "_b_dayp", "_b_adj", "_b_clean"), "sums"), [*PIECE])
    d = d.withColumns({"_adj": F.coalesce(adjusted("_sy"), "_b_adj"), "_adjp": F.coalesce(adjusted("_syp"), "_b_adj"), "_dayp": F.coalesce("_dayp", "_b_dayp"), "_lostw": F.coalesce(F.col("_clean") + F.coalesce("_b_losses", F.lit(0)), "_b_clean")})
    d = d.withColumns({n: _plus(F.col(n), F.col(f"_b{n}")) for n in sums})

    base = F.lit(float(initial))
    if baseline is not None:
        good = baseline.where(F.col("equity").isNotNull() & ~F.isnan("equity") & (F.col("equity") > 0) & (F.col("equity") < float("inf"))).groupBy("account").agg(F.first("equity").alias("_base"))
        d, base = d.join(good, "account", "left"), F.coalesce("_base", F.lit(float(initial)))
    d = d.withColumn("_base", base)

    start = F.lit(float(initial))
    cash = F.coalesce("_adj", start) + F.col("_cash")
    prior = F.coalesce("_adjp", start) + F.col("_cash") - F.col("_paid") + F.col("unrealised") - F.col("_float")
    d = d.withColumns({"cash": cash, "equity": cash + F.col("unrealised")})
    rolls = F.col("_day").isNotNull() & (F.col("_dayp").isNull() | (F.col("_day") != F.col("_dayp")))
    week = lambda c: F.floor((F.col(c) + TO_MONDAY) / 7)
    fresh = F.col("_day").isNotNull() & (F.col("_dayp").isNull() | (week("_day") != week("_dayp")))
    at_start = F.when(F.col("_dayp").isNull(), F.col("_base")).otherwise(prior)
    d = d.withColumns({"_peaks": F.when(is_("close") & F.col("_held"), F.col("equity") - F.col("_float")).when(is_("mark") & F.col("_held") | F.col("_syncs"), F.col("equity")), "_open": F.when(rolls, F.struct((F.col("_reals") - F.col("_real")).alias("real"), at_start.alias("equity"))), "_monday": F.when(fresh, F.col("_reals") - F.col("_real"))})
    at = lambda c: F.when(F.col(c).isNotNull(), F.col("_in"))
    tops = d.groupBy(*PIECE).agg(F.max("_peaks").alias("_top"), F.max(at("_open")).alias("_at"), *(F.max_by(F.col(f"_open.{n}"), at("_open")).alias(n) for n in ("real", "equity")), F.max_by("_monday", at("_monday")).alias("_week"))
    tops = tops.withColumn("_from", F.when(F.col("_at").isNotNull(), F.struct("real", "equity")))
    d = d.join(cut(tops.select(*PIECE, F.max("_top").over(before).alias("_b_top"), latest("_from").over(before).alias("_b_from"), latest("_week").over(before).alias("_b_week")), "states"), [*PIECE])
    d = d.withColumns({"_top": F.greatest(F.max("_peaks").over(so_far), "_b_top"), "_from": F.coalesce(latest("_open").over(so_far), "_b_from"), "_week": F.coalesce(latest("_monday").over(so_far), "_b_week")})

    peak = F.greatest(F.col("_base"), F.coalesce("_top", F.col("_base")))
    day_start = F.coalesce(F.when(F.col("_from.equity") > 0, F.col("_from.equity")), F.col("_base"))
    today = F.col("_reals") - F.coalesce("_from.real", F.lit(0.0)) + F.col("unrealised")
    this_week = F.col("_reals") - F.coalesce("_week", F.lit(0.0)) + F.col("unrealised")
    return d.select(
        "account", "fill_id", "ts", "symbol", kind, "position", "avg_price", F.col("_real").alias("realised"), "cash", "unrealised", "equity",
        peak.alias("peak"), F.when(peak > 0, F.greatest((peak - F.col("equity")) / peak, F.lit(0.0))).otherwise(0.0).alias("drawdown"), F.when(day_start > 0, today / day_start).otherwise(0.0).alias("daily_pnl_pct"), F.when(F.col("_base") > 0, this_week / F.col("_base")).otherwise(0.0).alias("weekly_pnl_pct"),
        (F.col("_losses") - F.coalesce("_lostw", F.lit(0))).alias("loss_streak"),
    )


def latest_states(states: DataFrame) -> DataFrame:
    """The newest state of each account."""
    rest = [c for c in states.columns if c != "account"]
    return states.groupBy("account").agg(F.max_by(F.struct(*rest), F.struct("ts", "fill_id")).alias("_r")).select("account", "_r.*")
