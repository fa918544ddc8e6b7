"""Text reports of one-row and small results, and the frames behind charts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def format_backtest(summary: DataFrame) -> str:
    """A summary row as lines; nothing traded says so."""
    row = summary.first().asDict()
    if not row["n_trades"]:
        return f"{row['n_signals']} signals, no trades"
    lines = [f"{row['n_trades']} trades of {row['n_signals']} signals ({row['n_blocked']} blocked, {row['n_unfilled']} unfilled)"]
    lines += [f"{name:>18}: {row[name]:.4f}" for name in ("hit_rate", "resolved_share", "resolved_hit_rate", "gross_bps", "cost_bps", "net_bps", "mean_hold_s", "total_return", "max_drawdown", "sharpe") if row.get(name) is not None]
    return "\n".join(lines)


def format_table(rows: DataFrame, limit: int = 50) -> str:
    """A result table, of at most `limit` rows, in columns."""
    held = rows.limit(limit).collect()
    cells = [rows.columns, *([f"{v:.4f}" if isinstance(v, float) else str(v) for v in r] for r in held)]
    widths = [max(len(r[i]) for r in cells) for i in range(len(rows.columns))]
    return "\n".join("  ".join(c.rjust(w) for c, w in zip(r, widths)) for r in cells)


def format_dataset(rows: DataFrame, window: int, horizon: int) -> str:
    """Windows and positive rate by split, of rows (split, y)."""
    parts = {r["split"]: r for r in rows.groupBy("split").agg(F.count("*").alias("n"), F.avg(F.col("y").cast("double")).alias("rate")).collect()}
    lines = [f"window {window} bars, horizon {horizon} bars"]
    return "\n".join(lines + [f"{s:>6}: {parts[s]['n']:>10,} windows, positive {parts[s]['rate']:.2%}" for s in ("train", "val", "test") if s in parts])


def thinned_prices(bars: DataFrame, points: int = 2000) -> DataFrame:
    """Every n-th bar, for a line chart of about that many points."""
    n = bars.agg(F.greatest((F.max("bar_idx") + 1) / F.lit(points), F.lit(1)).cast("long").alias("_step"))
    return bars.join(F.broadcast(n)).filter(F.col("bar_idx") % F.col("_step") == 0).select("ts", "price")


def gross_and_net(pooled: DataFrame, gate: DataFrame, least: int = 100) -> DataFrame:
    """(model, gross_bps, net_bps) at one gate (gate, q), of configurations with more than `least` trades."""
    return pooled.join(F.broadcast(gate), ["gate", "q"]).filter(F.col("n_trades") > least).select("model", "gross_bps", "net_bps")
