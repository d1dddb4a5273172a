"""Splits that keep related records together (problem 6).

1. Records and the entities they name form a bipartite graph.  A record of the ledger
   names its group, the spelling of the group it was delivered with, and the values of
   further entity columns; lines that name the same entities are one record.  Labels
   spread from records to entities and back until they are stable, each side taking
   the smallest label of the other; a round ends with a jump to the label's own label,
   so that long chains take few rounds.
2. Components are assigned to splits.  The few components that hold more than one
   in SHARE of all rows are placed one by one where the splits' rows and labels then
   deviate least; all others are stratified by their label profile and size and laid
   in random order, stratum after stratum, along the proportions that fill what is
   open in rows and in positives.

Lines of a ledger are summed once each.  A repeat is the same whole line: group,
partition, rows, both labels, sources and time, in their plain spelling.  A repeat
may also come early or late: the same line at another time that stands alone, no
other line of its group being of its day or the days beside it.  Equal lines among
others of their group are lines of their own.

Defined results: null entities link nothing; a record without entities is a
component of its own and is not in the entity table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Scratch
from ..skew import SHARE, join_unique

MAX_ROUNDS = 200
BUCKETS = 256
#: Splits that may be asked for.
MOST_SPLITS = 1000

#: The partitions of the ledger in their plain spelling.
PARTITIONS = ("S-train", "S-cal", "S-generic-bank", "S-test", "T-bank", "T-eval", "U-eval", "T-bank-discarded-positive")


def entity_components(links: DataFrame, record: str, entity: str, scratch: Scratch, rounds: list[int] | None = None) -> DataFrame:
    """(entity, component): component is the smallest entity linked to it through
    records.  ``links`` has a row for every entity a record names.  The number of labels
    after each round is appended to ``rounds``."""
    edges = scratch.keep(links.select(F.col(record).alias("record"), F.col(entity).alias("entity")).where("record is not null and entity is not null").distinct())
    # a record with one entity links nothing: only shared records carry labels
    carrying = scratch.keep(edges.join(edges.groupBy("record").count().where("count > 1").select("record"), "record"))
    n = carrying.count()
    alone = edges.select("entity").distinct()
    if not n:
        return scratch.keep(alone.withColumn("component", F.col("entity")))
    # ``n`` of an entity: its links, by which hot ones are known
    labels = scratch.keep(carrying.groupBy("entity").agg(F.count("*").alias("n")).withColumn("component", F.col("entity")))
    state = None
    for _ in range(MAX_ROUNDS):
        on_records = join_unique(carrying, labels, ["entity"], "n", n).groupBy("record").agg(F.min("component").alias("heard"))
        on_entities = carrying.join(on_records, "record").groupBy("entity").agg(F.min("heard").alias("heard"))
        spread = scratch.keep(labels.join(on_entities, "entity").select("entity", "n", "heard"))
        members = spread.groupBy("heard").agg(F.count("*").alias("members"))
        parent = members.join(spread.select(F.col("entity").alias("heard"), F.col("heard").alias("component")), "heard")
        fresh = scratch.keep(join_unique(spread, parent, ["heard"], "members", n).select("entity", "n", "component"))
        scratch.drop(labels, spread)
        labels, before = fresh, state
        state = tuple(labels.agg(F.countDistinct("component"), F.bit_xor(F.xxhash64("entity", "component")), F.sum(F.hash("component", "entity").cast("long"))).first())
        if rounds is not None:
            rounds.append(state[0])
        if state == before:
            lone = alone.join(labels, "entity", "left_anti").withColumn("component", F.col("entity"))
            return scratch.keep(labels.select("entity", "component").unionByName(lone))
    raise RuntimeError("labels did not become stable")


def plain_group(column: Column) -> Column:
    """``g:`` and 20 lower-case hex digits, however it is spelled; null if it is none."""
    digits = F.regexp_extract(F.lower(F.regexp_replace(column, r"^[\s ]+|[\s ]+$", "")), r"^(?:g:)?\s*([0-9a-f]{20})$", 1)
    return F.when(digits != "", F.concat(F.lit("g:"), digits))


def plain_partition(column: Column) -> Column:
    """Plain spelling of a partition; discarded positives belong to T-bank; null if empty."""
    s = F.regexp_replace(F.lower(F.regexp_replace(column, r"^[\s ]+|[\s ]+$", "")), r"[_\s]+", "-")
    named = F.create_map(*[F.lit(x) for p in PARTITIONS for x in (p.lower(), "T-bank" if p.startswith("T-bank") else p)])
    return F.when(s != "", F.coalesce(F.element_at(named, s), s))


def place_large(sizes: list[tuple[int, int]], shares: list[float], total: int, positive: int) -> tuple[list[int], list[list[int]]]:
    """Split of each (rows, positives), in this order, and [rows, positives] of the splits.

    A component goes where the splits' positives and negatives deviate least from their
    shares of what is placed so far, among the splits that have room for it; if none
    has, to the one with most room.
    """
    held = [[0, 0] for _ in shares]
    whole = (max(1, positive), max(1, total - positive))
    placed, out = [0, 0], []

    def deviation(at: int, n: int, p: int) -> float:
        # only this split's terms change with the choice
        def term(x: int, more: tuple[int, int]) -> float:
            now = (held[x][1] + more[1], held[x][0] - held[x][1] + more[0] - more[1])
            due = (placed[1] + p, placed[0] - placed[1] + n - p)
            return sum(((a - shares[x] * d) / w) ** 2 for a, d, w in zip(now, due, whole)) / shares[x]

        return term(at, (n, p)) - term(at, (0, 0))

    for n, p in sizes:
        room = [x for x, s in enumerate(shares) if held[x][0] + n <= s * total]
        at = min(room, key=lambda x: deviation(x, n, p)) if room else max(range(len(shares)), key=lambda x: shares[x] * total - held[x][0])
        for k, v in enumerate((n, p)):
            held[at][k] += v
            placed[k] += v
        out.append(at)
    return out, held


def fill_shares(strata: list[tuple[int, int]], rows: list[float], positives: list[float]) -> list[list[float]]:
    """For strata of (rows, positives) the shares of each that go to the splits, so that
    these get about the wanted rows and positives.

    A stratum with a share r of positives gives r * a + (1 - r) * b to a split; a and b
    solve both sums.  Shares below zero become zero.
    """
    n, p = sum(x for x, _ in strata), sum(y for _, y in strata)
    base = sum(rows) or 1.0
    rows = [x / base * n for x in rows]
    positives = [min(x, y) for x, y in zip(positives, rows)]
    base = sum(positives) or 1.0
    positives = [x / base * p for x in positives]
    pp, pn, nn = (sum(f(y / x) * x for x, y in strata) for f in (lambda r: r * r, lambda r: r * (1 - r), lambda r: (1 - r) ** 2))
    det = pp * nn - pn * pn
    if n == 0 or det <= 1e-9 * n * n:
        a = b = [x / max(1, n) for x in rows]
    else:
        a = [(q * nn - (x - q) * pn) / det for x, q in zip(rows, positives)]
        b = [((x - q) * pp - q * pn) / det for x, q in zip(rows, positives)]
    out = []
    for x, y in strata:
        given = [max(0.0, y / x * u + (1 - y / x) * v) for u, v in zip(a, b)]
        whole = sum(given)
        out.append([g / whole for g in given] if whole else [x / max(1, n) for x in rows])
    return out


class GroupSplit:
    """Groups of a ledger, their components and their assignment to splits.

    ``entities``: further columns whose values tie the groups of lines together, as an
    author or a source page; without any, only spellings of a group are tied.
    ``rounds``: the number of labels after each round of propagation.
    """

    def __init__(self, ledger: DataFrame, group: str = "group", partition: str = "partition", rows: str = "rows", labels: str = "labels", sources: str = "sources", time: str = "recorded_at", entities: Sequence[str] = ()) -> None:
        self.scratch = Scratch(ledger.sparkSession)
        label = lambda k: F.coalesce(F.col(f"`{labels}`.`{k}`"), F.lit(0)).cast("long")
        # tables without sources or times have lines that are told apart by the rest
        named = F.array_sort(F.map_entries(F.col(f"`{sources}`"))) if sources in ledger.columns else F.lit(None).cast("string")
        at = F.col(f"`{time}`").cast("timestamp") if time in ledger.columns else F.lit(None).cast("timestamp")
        lines = ledger.select(plain_group(F.col(f"`{group}`")).alias("group_key"), plain_partition(F.col(f"`{partition}`")).alias("part"), F.col(f"`{rows}`").cast("long").alias("n"), label(0).alias("benign"), label(1).alias("positive"), named.alias("sources"), at.alias("at"))
        once = lines.where("group_key is not null and part is not null and n > 0").distinct()
        same = ["group_key", "part", "n", "benign", "positive", "sources"]
        daily = self.scratch.keep(once.withColumn("day", F.to_date("at")).groupBy(*same, "day").agg(F.count("*").alias("lines")))
        around = F.explode(F.array(F.date_sub("day", 1), F.col("day"), F.date_add("day", 1))).alias("day")
        lone = daily.where("day is not null").select("group_key", around, "lines").groupBy("group_key", "day").agg(F.sum("lines").alias("lines")).where("lines = 1").select("group_key", "day", F.lit(0).alias("beside"))
        # of equal lines those among others count, else one
        beside = F.sum(F.coalesce("beside", "lines"))
        counted = daily.join(lone, ["group_key", "day"], "left").groupBy(*same).agg(F.greatest(beside, F.lit(1)).alias("lines"))
        # a record of the ledger is what a group has in a partition
        self.records = self.scratch.keep(counted.groupBy("group_key", "part").agg(F.sum(F.col("n") * F.col("lines")).alias("n"), F.sum(F.col("positive") * F.col("lines")).alias("positive")))
        counts = plain_partition(F.col(f"`{partition}`")).isNotNull() & (F.col(f"`{rows}`") > 0)
        spelled = F.col(f"`{group}`")
        named = ledger.where(counts).select(plain_group(spelled).alias("group_key"), spelled.alias("spelling"), *[F.col(f"`{e}`").cast("string").alias(f"e{k}") for k, e in enumerate(entities)]).where("group_key is not null").distinct()
        values = [F.col("group_key"), F.when(F.col("spelling") != F.col("group_key"), F.concat(F.lit("spelling="), "spelling"))]
        values += [F.concat(F.lit(f"{e}="), F.col(f"e{k}")) for k, e in enumerate(entities)]
        links = named.select(F.md5(F.to_json(F.struct(*named.columns))).alias("record"), F.explode(F.array_compact(F.array(*values))).alias("entity"))
        self.rounds: list[int] = []
        components = entity_components(links, "record", "entity", self.scratch, self.rounds)
        self.components = components.where(F.col("entity").rlike("^g:[0-9a-f]{20}$"))

    def torn(self) -> DataFrame:
        """(group_key): groups whose component lies in two or more partitions."""
        placed = self.records.join(self.components.withColumnRenamed("entity", "group_key"), "group_key")
        spread = placed.groupBy("component").agg(F.countDistinct("part").alias("parts")).where("parts > 1")
        return self.components.join(spread, "component", "left_semi").select(F.col("entity").alias("group_key"))

    def linked(self) -> DataFrame:
        """(group_key, component): component is the smallest entity linked to the group."""
        return self.components.withColumnRenamed("entity", "group_key")

    def balance(self, targets: DataFrame) -> DataFrame:
        """(split, target, groups, rows, row_share, positive_share) of the assignment;
        the share of positives is that of the split's rows."""
        placed = self.assign(targets)
        counts = self.records.groupBy("group_key").agg(F.sum("positive").alias("positive"))
        per = placed.join(counts, "group_key").groupBy("split").agg(F.count("*").alias("groups"), F.sum("n").alias("rows"), F.sum("positive").alias("positive"))
        whole = placed.agg(F.sum("n").alias("total"))
        goals = targets.where("category is not null and share > 0").select(F.col("category").alias("split"), F.col("share").alias("target"))
        return per.join(F.broadcast(goals), "split").join(F.broadcast(whole)).select("split", "target", "groups", "rows", (F.col("rows") / F.col("total")).alias("row_share"), (F.col("positive") / F.col("rows")).alias("positive_share"))

    def assign(self, targets: DataFrame, seed: str = "split") -> DataFrame:
        """(group_key, split, n): every group in one split, shares of rows near the
        targets (category, share) and label profiles alike in all splits."""
        goals = [(r.category, float(r.share)) for r in targets.where("category is not null and share > 0").orderBy(F.desc("share"), "category").limit(MOST_SPLITS + 1).collect()]
        if len(goals) > MOST_SPLITS:
            raise ValueError(f"more than {MOST_SPLITS} splits")
        if not goals:
            raise ValueError("no target shares")
        whole = sum(s for _, s in goals)
        goals = [(c, s / whole) for c, s in goals]
        sized = self.records.join(self.components.withColumnRenamed("entity", "group_key"), "group_key").groupBy("component").agg(F.sum("n").alias("n"), F.least(F.sum("positive"), F.sum("n")).alias("positive"))
        # a component's stratum: its label profile in fifths and its size in powers of four
        profile = F.floor(F.col("positive") * 5 / (F.col("n") + 1))
        sized = self.scratch.keep(sized.withColumn("stratum", profile * 100 + F.floor(F.log2("n") / 2)).withColumn("draw", F.xxhash64(F.lit(seed), "component")).withColumn("slice", F.pmod(F.shiftright("draw", 56), F.lit(BUCKETS)).cast("int")))
        total, positive = (x or 0 for x in sized.agg(F.sum("n"), F.sum("positive")).first())
        big = sized.where(F.col("n") * SHARE > F.lit(total)).orderBy(F.desc("n"), "component").collect()  # at most SHARE rows
        names, shares = [c for c, _ in goals], [s for _, s in goals]
        at, held = place_large([(r.n, r.positive) for r in big], shares, total, positive)
        spark = self.records.sparkSession
        first = spark.createDataFrame([(r.component, names[x]) for r, x in zip(big, at)], "component string, split string")
        small = sized.where(F.col("n") * SHARE <= F.lit(total))
        # what the large ones left open, laid over 0..1 of every stratum; strata are few (5 profiles, 32 sizes)
        strata = small.groupBy("stratum").agg(F.sum("n").alias("n"), F.sum("positive").alias("positive")).orderBy("stratum").collect()
        open_ = [[max(0.0, s * t - h[k]) for s, h in zip(shares, held)] for k, t in enumerate((total, positive))]
        given = fill_shares([(r.n, r.positive) for r in strata], *open_)
        ends = spark.createDataFrame([(r.stratum, [sum(g[: k + 1]) for k in range(len(g) - 1)]) for r, g in zip(strata, given)], "stratum long, ends array<double>")
        # running rows before a component, stratum by stratum: sums of slices (a bounded
        # number) are added to sums within a slice, so that no window spans all rows
        sliced = small.groupBy("stratum", "slice").agg(F.sum("n").alias("rows"))
        upto = Window.partitionBy("stratum").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
        offset = sliced.select("stratum", "slice", F.coalesce(F.sum("rows").over(upto), F.lit(0)).alias("offset"), F.sum("rows").over(Window.partitionBy("stratum")).alias("stratum_rows"))
        inside = Window.partitionBy("stratum", "slice").orderBy("draw", "component").rowsBetween(Window.unboundedPreceding, -1)
        run = small.join(F.broadcast(offset), ["stratum", "slice"]).withColumn("before", F.coalesce(F.sum("n").over(inside), F.lit(0)) + F.col("offset"))
        place = (F.col("before") + F.col("n") / 2) / F.col("stratum_rows")
        passed = F.size(F.filter("ends", lambda e: e <= F.col("place")))
        split = F.element_at(F.array(*[F.lit(c) for c in names]), passed + 1)
        rest = run.withColumn("place", place).join(F.broadcast(ends), "stratum").select("component", split.alias("split"))
        placed = first.unionByName(rest)
        groups = self.records.groupBy("group_key").agg(F.sum("n").alias("n"))
        return groups.join(self.components.withColumnRenamed("entity", "group_key"), "group_key").join(placed, "component").select("group_key", "split", "n")
