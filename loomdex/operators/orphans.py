"""References to records that do not exist (problem 3).

Method: a ledger with keyed pending-orphan state, advanced by batches of references and changes of
parents, such as those of a period. It holds a parent index (per key: how many of its spans have
begun, are open, have ended) and the orphans found so far. New references probe the index as it is
at their own time; arriving parents resolve the orphans that wait for them; deletions reopen them.

What an advance writes is in proportion to its batch and to the orphans that wait: the index is a
base table and a short list of deltas that are merged into a new base only when they have grown to
a part of it, and orphans whose reason is settled are appended, never read again. Whether an orphan
is open follows from its key's row in the index, so deletions and returns cost one index row.

Hot keys: references are never grouped by key. They meet the index in joins whose other side has
one row per key, which AQE can split. A key's changes of one batch lie in its index row as a short
list; keys with more than ``MANY_CHANGES`` of them are placed by running sums that cut heavy groups
into ranges.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import BROADCAST_ROWS, cut, scratch_path
from .running import running_sum

KEY = ["space", "key"]
COUNTS = ["begun", "opened", "ended"]
#: Changes of one key in one batch that its index row lists; keys with more go by running sums.
MANY_CHANGES = 500
ALWAYS = -(2**62)


def micros(t: Column) -> Column:
    return F.unix_micros(t.cast("timestamp"))


def month_of(at: Column) -> Column:
    """The UTC month of a time in microseconds, as ``2023-04``, whatever the session's zone."""
    return F.date_format(F.date_from_unix_date(F.floor(at / 86_400_000_000).cast("int")), "yyyy-MM")


def span_changes(spans: DataFrame) -> DataFrame:
    """Changes ``(space, key, at, begun, opened, ended)`` of ``(space, key, begins, ends)``, times
    in microseconds, null for always and still. Repeated spans count once. A span that ends before
    it begins never exists: it has begun and ended at its end."""
    s = spans.where("space is not null and key is not null").distinct()
    begins, ends = F.coalesce("begins", F.lit(ALWAYS)), F.col("ends")
    sane = ends.isNull() | (ends > begins)
    change = lambda at, begun, opened, ended: F.struct(at.alias("at"), F.lit(begun).alias("begun"), F.lit(opened).alias("opened"), F.lit(ended).alias("ended"))
    changes = F.when(sane & ends.isNull(), F.array(change(begins, 1, 1, 0))).when(sane, F.array(change(begins, 1, 1, 0), change(ends, 0, -1, 1))).otherwise(F.array(change(ends, 1, 0, 1)))
    return s.select(*KEY, F.explode(changes).alias("c")).select(*KEY, "c.*")


def _side(df: DataFrame, rows: int) -> DataFrame:
    """``df`` of at most ``rows`` rows, counted before, to be broadcast if it is small."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def many_changes(changes: DataFrame) -> tuple[DataFrame, int]:
    """Keys with more than ``MANY_CHANGES`` changes, and their number."""
    many = cut(changes.groupBy(*KEY).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > MANY_CHANGES).select(*KEY), "many")
    return many, many.count()


class OrphanLedger:
    """State of the ledger; every advance appends new state tables in the shared folder.

    References are ``(field, src_id, space, key, at)`` with ``at`` in microseconds; rows with a
    null key or time are no reference. Repeated references count once.
    """

    ORPHAN = "field string, src_id long, space string, key string, at long"

    def __init__(self, spark):
        self.spark = spark
        #: The parent index: ``(space, key, begun, opened, ended)`` as a base and later deltas.
        self.base: DataFrame | None = None
        self.deltas: list[DataFrame] = []
        self.sizes = [0, 0]  # rows of the base and of the deltas
        #: Orphans of settled reason (deleted, late), and those that wait for their parent.
        self.settled: list[DataFrame] = []
        self.waiting = spark.createDataFrame([], self.ORPHAN)
        #: All changes and the last month of references, where :func:`run_ledger` filled the ledger.
        self.changes = spark.createDataFrame([], "space string, key string, at long, begun int, opened int, ended int")
        self.last_month: str | None = None
        #: What the last advance changed, for :meth:`save`.
        self.news: dict[str, DataFrame] = {}
        self.snapshots = spark.createDataFrame([], "as_of long, field string, month string, reason string, open boolean, n long")

    # ------------------------------------------------------------ the index

    def index(self) -> DataFrame:
        """``(space, key, begun, opened, ended)`` of every key that ever changed, as of now."""
        parts = [*([] if self.base is None else [self.base]), *self.deltas]
        if not parts:
            return self.spark.createDataFrame([], "space string, key string, begun long, opened long, ended long")
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out if len(parts) == 1 else out.groupBy(*KEY).agg(*[F.sum(c).alias(c) for c in COUNTS])

    def _append(self, delta: DataFrame, rows: int) -> None:
        """Add a delta; once the deltas together are a quarter of the base, merge them into it."""
        self.deltas.append(delta)
        self.sizes[1] += rows
        if self.base is None and len(self.deltas) == 1:
            self.base, self.deltas, self.sizes = delta, [], [rows, 0]
        elif 4 * self.sizes[1] > self.sizes[0]:
            self.base, self.deltas = cut(self.index(), "index"), []
            self.sizes = [sum(self.sizes), 0]

    # ------------------------------------------------------------ one batch

    def advance(self, refs: DataFrame, changes: DataFrame, as_of: int, many: tuple[DataFrame, int] | None = None) -> None:
        """Take in the references and parent changes of one period that ends at ``as_of``. ``many``
        may give :func:`many_changes` of these or more changes, where it is known."""
        keys, some_many = many_changes(changes) if many is None else many
        listed = changes.join(_side(keys.withColumn("_many", F.lit(True)), some_many), KEY, "left") if some_many else changes.withColumn("_many", F.lit(None).cast("boolean"))
        change = F.when(F.col("_many").isNull(), F.struct("at", *COUNTS))  # nulls are not collected
        moved = cut(listed.groupBy(*KEY).agg(*[F.sum(c).alias(c) for c in COUNTS], F.first("_many").alias("many"), F.collect_list(change).alias("steps")), "moved")

        rows, steps = moved.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("steps")), F.lit(0))).first()
        found = self._probe(refs.where("key is not null and at is not null"), moved, max(rows, steps), changes, some_many)
        found = cut(found.distinct(), "found")

        # arrivals of this batch resolve what waits, old and new
        waiting = self.waiting.unionByName(found.where("not deleted").drop("deleted"))
        arrived = moved.where("begun > 0").select(*KEY)
        orphan = F.struct(*[f.split(" ")[0] for f in self.ORPHAN.split(", ")])
        marked = cut(waiting.join(_side(arrived.withColumn("_here", F.lit(True)), rows), KEY, "left").select(orphan.alias("o"), F.col("_here").isNotNull().alias("late")), "waiting")
        self.waiting = marked.where("not late").select("o.*")
        self.settled += [found.where("deleted").drop("deleted").withColumn("reason", F.lit("deleted")), marked.where("late").select("o.*", F.lit("late").alias("reason"))]
        self._append(moved.select(*KEY, *COUNTS), rows)
        self.news = {"deltas": moved.select(*KEY, *COUNTS), "waiting": self.waiting, "settled": self.settled[-2].unionByName(self.settled[-1])}
        counts = self.orphans(True).groupBy("field", month_of(F.col("at")).alias("month"), "reason", "open").agg(F.count(F.lit(1)).alias("n"))
        latest = counts.select(F.lit(as_of).cast("long").alias("as_of"), "*")
        self.news["snapshots"] = latest
        self.snapshots = self.snapshots.unionByName(latest)

    # ------------------------------------------------------------ kept state

    def save(self, root: str, number: int) -> None:
        """Store what the last advance changed as batch ``number`` below ``root``: the changes of
        the index, the orphans settled and the counts are added, those waiting written anew. The
        batch counts once its mark is there; a batch saved again replaces itself."""
        for name, df in self.news.items():
            df.write.mode("overwrite").parquet(f"{root}/{name}/batch={number}")
        self.spark.range(1).coalesce(1).write.mode("overwrite").parquet(f"{root}/done/batch={number}")

    @classmethod
    def load(cls, spark, root: str) -> tuple[OrphanLedger, int]:
        """The ledger as of the last whole batch below ``root`` and that batch's number, -1 if
        there is none. What a batch left unfinished is not read."""
        ledger, root = cls(spark), root.rstrip("/")
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/done")
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        done = [int(f.getPath().getName().split("=")[1]) for f in files.listStatus(path) if files.exists(spark._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))] if files.exists(path) else []
        if not done:
            return ledger, -1
        last = max(done)
        schema = {"deltas": "space string, key string, begun long, opened long, ended long", "settled": f"{cls.ORPHAN}, reason string", "snapshots": "as_of long, field string, month string, reason string, open boolean, n long"}
        stored = {name: spark.read.schema(f"{columns}, batch int").option("basePath", f"{root}/{name}").parquet(f"{root}/{name}").where(F.col("batch") <= last).drop("batch") for name, columns in schema.items()}
        ledger.base = cut(stored["deltas"].groupBy(*KEY).agg(*[F.sum(c).alias(c) for c in COUNTS]), "index")
        ledger.sizes = [ledger.base.count(), 0]
        ledger.settled, ledger.snapshots = [stored["settled"]], stored["snapshots"]
        ledger.waiting = spark.read.schema(cls.ORPHAN).parquet(f"{root}/waiting/batch={last}")
        return ledger, last

    def _probe(self, refs: DataFrame, moved: DataFrame, rows: int, changes: DataFrame, some_many: int) -> DataFrame:
        """``(field, src_id, space, key, at, deleted)`` of the references whose parent was not there
        at their time: the index before this batch and the batch's changes up to that time."""
        at_first = [F.lit(0).cast("long").alias(c) for c in ("b0", "o0", "e0")]
        state = refs.select("field", "src_id", *KEY, "at")
        if self.base is None:
            state = state.select("*", *at_first)
        else:
            before = self.base.select(*KEY, *[F.col(c).alias(f"{c[0]}0") for c in COUNTS])
            state = state.join(before, KEY, "left").select("field", "src_id", *KEY, "at", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("b0", "o0", "e0")])
        for delta in self.deltas:
            since = _side(delta.select(*KEY, *[F.col(c).alias(f"_{c}") for c in COUNTS]), self.sizes[1])
            state = state.join(since, KEY, "left").select("field", "src_id", *KEY, "at", *[(F.col(f"{c[0]}0") + F.coalesce(f"_{c}", F.lit(0))).alias(f"{c[0]}0") for c in COUNTS])
        probed = state.join(_side(moved.select(*KEY, "many", "steps"), rows), KEY, "left")
        upto = lambda c: F.aggregate(F.filter("steps", lambda x: x["at"] <= F.col("at")), F.lit(0).cast("long"), lambda acc, x: acc + x[c])
        # most keys do not change, or have no more than one change that was always true
        lasting = (F.size("steps") == 1) & (F.element_at("steps", 1)["at"] == ALWAYS)
        here = F.when(F.col("steps").isNull(), F.col("o0")).when(lasting, F.col("o0") + F.element_at("steps", 1)["opened"]).otherwise(F.col("o0") + upto("opened"))
        ended = F.col("e0") + F.when(F.col("steps").isNull(), 0).otherwise(upto("ended"))
        short = probed.where("many is null").where(here <= 0).select("field", "src_id", *KEY, "at", (ended > 0).alias("deleted"))
        if not some_many:
            return short
        placed = self._place(probed.where("many").drop("many", "steps"), changes.join(_side(moved.where("many").select(*KEY), some_many), KEY, "left_semi"))
        return short.unionByName(placed.where("o0 <= 0").select("field", "src_id", *KEY, "at", (F.col("e0") > 0).alias("deleted")))

    @staticmethod
    def _place(refs: DataFrame, changes: DataFrame) -> DataFrame:
        """References to keys of very many changes with the changes up to their time added to b0, o0, e0."""
        zero = F.lit(0).cast("long")
        refs = refs.distinct()
        timeline = refs.select(*KEY, "at", F.lit(1).alias("side"), "field", "src_id", "b0", "o0", "e0", zero.alias("begun"), zero.alias("opened"), zero.alias("ended")).unionByName(
            changes.groupBy(*KEY, "at").agg(*[F.sum(c).cast("long").alias(c) for c in COUNTS]).withColumn("side", F.lit(0)), allowMissingColumns=True)
        sums = {"_b": "begun", "_o": "opened", "_e": "ended"}
        timeline = running_sum(timeline, KEY, ["at", "side", "field", "src_id"], sums).withColumns({"b0": F.col("b0") + F.col("_b"), "o0": F.col("o0") + F.col("_o"), "e0": F.col("e0") + F.col("_e")})
        return timeline.where("side = 1").select(*refs.columns)

    # ------------------------------------------------------------ reports

    def orphans(self, with_open: bool = False) -> DataFrame:
        """Every orphan found so far with its ``reason`` (deleted, late, waiting) and, if wanted,
        whether it is ``open``: no span of its key is, as of now."""
        out = self.waiting.withColumn("reason", F.lit("waiting"))
        for s in self.settled:
            out = out.unionByName(s)
        if not with_open:
            return out
        return out.join(self.index().select(*KEY, "opened"), KEY, "left").withColumn("open", F.coalesce("opened", F.lit(0)) <= 0).drop("opened")

    def report(self, with_open: bool = True) -> DataFrame:
        """``(field, src_id, key, reason, month[, open])`` of every orphan; those still waiting are
        missing. Month is that of the reference."""
        shown = F.when(F.col("reason") == "waiting", "missing").otherwise(F.col("reason")).alias("reason")
        return self.orphans(with_open).select("field", "src_id", "key", shown, month_of(F.col("at")).alias("month"), *(["open"] if with_open else [])).distinct()


def month_starts(first: datetime, last: datetime, months: int) -> list[datetime]:
    """Period ends every ``months`` months that cover ``first`` to ``last``."""
    out, year, month = [], first.year, first.month
    while not out or out[-1] <= last:
        month += months
        year, month = year + (month - 1) // 12, (month - 1) % 12 + 1
        out.append(datetime(year, month, 1))
    return out


def run_ledger(refs: DataFrame, spans: DataFrame, months: int = 24, times: DataFrame | None = None) -> OrphanLedger:
    """Advance a new ledger over all references in periods of ``months`` months of event time.
    The result does not depend on the periods; only the snapshots do. ``times (at)`` may give the
    times of the references where reading them alone is cheaper than reading ``refs``."""
    spark = refs.sparkSession
    ledger = OrphanLedger(spark)
    limits = (refs if times is None else times).agg(month_of(F.min("at")), month_of(F.max("at"))).first()
    if limits is None or limits[0] is None:
        return ledger
    changes = cut(span_changes(spans), "all-changes")
    ledger.changes, ledger.last_month = changes, limits[1]
    ends = month_starts(datetime.strptime(limits[0], "%Y-%m"), datetime.strptime(limits[1], "%Y-%m"), months)
    end_of = [int((end - datetime(1970, 1, 1)).total_seconds()) * 1_000_000 for end in ends]
    # the last period takes what is later too, the first what is earlier
    period = F.lit(0)
    for end in end_of[:-1]:
        period = period + F.when(F.col("at") >= end, 1).otherwise(0)
    if len(end_of) > 1:  # read and taken apart once, not once per period
        refs = _by_period(refs.where("key is not null and at is not null"), period, "refs")
    many = many_changes(changes)
    for k, end in enumerate(end_of):
        within = refs.where(F.col("_period") == k).drop("_period") if len(end_of) > 1 else refs
        ledger.advance(within, changes.where(period == k), end, many)
    return ledger


def _by_period(df: DataFrame, period: Column, name: str) -> DataFrame:
    """``df`` with ``_period`` as a table of one folder per period, of which a filter reads one."""
    path = scratch_path(df.sparkSession, name)
    made = df.withColumn("_period", period)
    made.write.partitionBy("_period").parquet(path)
    return df.sparkSession.read.schema(made.schema).parquet(path)


def month_number(at: Column) -> Column:
    """Months since year 0 of a time in microseconds; one before all others for always."""
    day = F.date_from_unix_date(F.floor(at / 86_400_000_000).cast("int"))
    return F.when(at <= ALWAYS, -1).otherwise(F.year(day) * 12 + F.month(day) - 1)


def monthly_snapshots(ledger: OrphanLedger) -> DataFrame:
    """Snapshots as of the end of every month from the first reference to the last reference or
    change, whatever periods the ledger was advanced in: ``(as_of, field, month, reason, open, n)``.

    An orphan's state follows from its key: waiting until a span has begun, open while none is.
    Orphans are counted by key and month, each count meets the few states of its key, and lasts
    from month to month until the next state.
    """
    per = ledger.changes.groupBy(*KEY, month_number(F.col("at")).alias("since")).agg(F.sum("begun").alias("begun"), F.sum("opened").alias("opened"))
    by_key = Window.partitionBy(*KEY).orderBy("since")
    upto = by_key.rowsBetween(Window.unboundedPreceding, 0)
    states = per.select(*KEY, "since", (F.sum("begun").over(upto) > 0).alias("arrived"), (F.sum("opened").over(upto) > 0).alias("there"), F.lead("since").over(by_key).alias("until"))
    before = per.groupBy(*KEY).agg(F.min("since").alias("until")).select(*KEY, F.lit(-2).alias("since"), F.lit(False).alias("arrived"), F.lit(False).alias("there"), "until")
    groups = ledger.orphans().groupBy(*KEY, "field", month_number(F.col("at")).alias("own"), month_of(F.col("at")).alias("month"), (F.col("reason") == "deleted").alias("deleted")).agg(F.count(F.lit(1)).alias("n"))
    asked = int(ledger.last_month[:4]) * 12 + int(ledger.last_month[5:]) - 1 if ledger.last_month else -1
    last = max(asked, per.agg(F.max("since")).first()[0] or -1)
    reason = F.when(F.col("deleted"), "deleted").when(F.col("arrived"), "late").otherwise("waiting")
    lasting = groups.join(states.unionByName(before), KEY, "left").select(
        "field", "month", reason.alias("reason"), (~F.coalesce("there", F.lit(False))).alias("open"), F.greatest("own", F.coalesce("since", F.lit(-2))).alias("first"), F.coalesce(F.col("until") - 1, F.lit(last)).alias("last"), "n")
    held = lasting.where("first <= last").groupBy("field", "month", "reason", "open", "first", "last").agg(F.sum("n").alias("n"))
    each = held.select("field", "month", "reason", "open", "n", F.explode(F.sequence("first", "last")).alias("at"))
    ends = F.unix_date(F.make_date(F.floor((F.col("at") + 1) / 12).cast("int"), (F.col("at") + 1) % 12 + 1, F.lit(1))).cast("long") * 86_400_000_000
    return each.groupBy(ends.alias("as_of"), "field", "month", "reason", "open").agg(F.sum("n").alias("n"))
