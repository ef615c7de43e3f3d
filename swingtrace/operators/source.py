"""Where a question reads from: events, or a rollup that carries the cut asked for.

Both answer with the same five summed columns, so everything above is written once.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swingtrace.config import Cut
from swingtrace.functions.masks import OPEN, Mask
from swingtrace.functions.metrics import event_measures, rollup_measures
from swingtrace.operators import rollup as R
from swingtrace.operators.enrich import enrich_star
from swingtrace.sources.adapter import Star


class EventSource:
    """Event rows, either a star joined on demand or an already flat view.

    ``name`` tells one source from another in the hashes of evidence; set it where several are in use.
    """

    name = ""

    def __init__(self, star: Star | None = None, flat: DataFrame | None = None):
        self._star, self._flat = star, flat

    def rows(self, dims: Iterable[str] | None = None) -> DataFrame:
        if self._flat is not None:
            return self._flat
        s = self._star
        return enrich_star(s.fact, s.apps, s.advertisers, s.geo_device, dims)

    @property
    def star(self) -> Star | None:
        return self._star

    def unrolled(self) -> EventSource:
        """The same events, without rollups."""
        return EventSource(self._star, self._flat)

    def grouped(
        self,
        by: Sequence[str],
        dims: Iterable[str] = (),
        mask: Mask = OPEN,
        where: Column | None = None,
    ) -> DataFrame:
        """Five sums per group of the events inside ``mask`` and ``where``."""
        rows = self.rows({*dims, *mask.dims})
        if where is not None:
            rows = rows.filter(where)
        return mask.apply(rows).groupBy(*by).agg(*event_measures())

    def cells(
        self, cuts: Sequence[Cut], mask: Mask = OPEN, where: Column | None = None
    ) -> DataFrame:
        """Daily cells of every cut."""
        rows = self.rows({d for c in cuts for d in c} | set(mask.dims))
        if where is not None:
            rows = rows.filter(where)
        return R.cells(mask.apply(rows), cuts, ("event_date",))

    def served_from(self, dims: Iterable[str], grain: str = "daily") -> str:
        return "raw"


class RollupSource(EventSource):
    """Reads the rollups where they carry the cut, the events otherwise.

    Before the first answer the rollups are checked once against the events: unless every key of both
    grains accounts for every event, all questions go to the events and ``reason`` says why. ``checked=False``
    trusts the rollups, as does a source without events.

    With a ``manifest`` (see ``rollup.manifest``) each day is judged by itself from that small table: the events are
    only counted, and only where their number differs are they counted by day. Good days are answered from the
    rollups, ``stale_days`` from the events, and both are added up.
    """

    def __init__(
        self,
        hourly: DataFrame,
        daily: DataFrame,
        star: Star | None = None,
        flat: DataFrame | None = None,
        checked: bool = True,
        manifest: DataFrame | None = None,
    ):
        super().__init__(star, flat)
        self.hourly, self.daily = hourly, daily
        trusted = not checked or (star is None and flat is None)
        self._manifest = None if trusted else manifest
        self._stale: list[dt.date] | None = None
        self._reason = "" if trusted or manifest is not None else None

    @property
    def reason(self) -> str:
        """Why the rollups are not read; empty if they are."""
        if self._reason is None:
            events = self._star.fact if self._flat is None else self._flat
            counted = events.agg(F.count(F.lit(1)).alias("fact_events"))
            self._reason = R.rollup_health(counted, self.hourly, self.daily).first()["reason"]
        return self._reason

    @property
    def stale_days(self) -> list[dt.date]:
        """Days that the rollups do not account for in full; at most one a calendar day."""
        if self._manifest is None:
            return []
        if self._stale is None:
            held = R.day_verdicts(self._manifest).collect()
            good = {r["event_date"]: r["total"] for r in held if not r["reason"]}
            wrong = {r["event_date"] for r in held} - set(good)
            events = self._star.fact if self._flat is None else self._flat
            if events.count() != sum(good.values()):
                per_day = super().grouped(["event_date"]).select("event_date", "events").collect()
                have = {r["event_date"]: r["events"] for r in per_day}
                wrong |= {d for d in set(have) | set(good) if have.get(d) != good.get(d)}
            self._stale = sorted(wrong)
        return self._stale

    def _split(self, where: Column | None) -> tuple[Column | None, Column | None]:
        """Conditions for the days from the rollups and for those from the events (None: no such day)."""
        if not self.stale_days:
            return where, None
        stale = F.col("event_date").isin(*self.stale_days)
        return (~stale, stale) if where is None else (where & ~stale, where & stale)

    def served_from(self, dims: Iterable[str], grain: str = "daily") -> str:
        if R.rollup_key(dims) and self.stale_days:
            return f"rollup:{grain}+raw"
        return f"rollup:{grain}" if R.rollup_key(dims) and not self.reason else "raw"

    def grouped(self, by, dims=(), mask=OPEN, where=None):
        hourly = "event_hour" in by
        rows = R.read_cut(self.hourly if hourly else self.daily, {*dims, *mask.dims})
        if rows is None or self.reason:
            return super().grouped(by, dims, mask, where)
        held, rest = self._split(where)
        if held is not None:
            rows = rows.filter(held)
        out = mask.apply(rows).groupBy(*by).agg(*rollup_measures())
        if rest is None:
            return out
        both = out.unionByName(super().grouped(by, dims, mask, rest).select(*out.columns))
        return both.groupBy(*by).agg(*rollup_measures())

    def cells(self, cuts, mask=OPEN, where=None):
        keys = ["|".join(c) for c in cuts]
        if not mask.is_open or not set(keys) <= set(R.ROLLUP_KEYS) or self.reason:
            return super().cells(cuts, mask, where)
        rows = self.daily.filter(F.col("dim").isin(*keys))
        held, rest = self._split(where)
        if held is not None:
            rows = rows.filter(held)
        # the daily rollup has one row per day, cut and value already
        rows = rows.select("event_date", "dim", "val", "events", "fills", "impressions", "clicks", "revenue")
        return rows if rest is None else rows.unionByName(super().cells(cuts, mask, rest).select(*rows.columns))
