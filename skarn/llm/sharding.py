"""Sharding by balanced label propagation, in DataFrame functions only.

Documents are linked where they share the value of a key (equal texts, unless other keys are given). Linked documents start spread
evenly over the shards. In each round every key's value votes for a home: the shard where it has, or could get, most of its
documents, which is the one with most of them already if there is room; a value with more documents than a shard has room for gets as many homes as it
needs. A linked document outside its homes asks to move to one. Moves are let through up to quotas, so that
no shard ever has more documents than its capacity: what a shard may take is its free room and what leaves it. Values with most documents move
first, and the documents of one value side by side. Rounds end when nobody moves. Documents that are linked with none fill up what room is left.

The law is `rows`: capacities are the number of documents over the shards, so sizes are at most one apart.

Each round is two joins on (value, salt): counts of a value by shard are partial sums, and values with many documents are
dealt over several salts, so none is a hot key. Only counts by pair of shards reach the driver. Numbers without gaps
(slots, places of unlinked documents) come from counts by bucket of a hash and a sort within each bucket.

Defined results: a null text is empty and equal to an empty one; rows that repeat are documents of their own, linked as their texts are equal;
ids may be null; a null value of a key links nothing; with fewer documents than shards some shards are empty; a very long text
counts as one document. Other columns are ignored, an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skarn.llm.common import cut, drop, fresh, spread_join

#: Documents of one value that meet in one task of a join.
SALT = 5000
#: Documents that are numbered in one task, about.
BUCKET = 20_000


def numbered(rows: DataFrame, by: list[str], uid: str, name: str, bucket: int = BUCKET) -> DataFrame:
    """rows with a number without gaps from 0 within each value of `by` (columns of few values), in the order of a hash of uid.

    A running sum over counts by bucket gives where each bucket starts; its rows are sorted on their own.
    """
    part, before = fresh("part", rows), fresh("before", rows)
    parts = max(1, -(-rows.count() // bucket))
    dealt = cut(rows.withColumn(part, F.pmod(F.xxhash64(uid, F.lit(3)), F.lit(parts))))
    n = dealt.groupBy(*by, part).agg(F.count(F.lit(1)).alias(before))
    upto = Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    n = n.withColumn(before, F.coalesce(F.sum(before).over(upto), F.lit(0)))
    within = Window.partitionBy(*by, part).orderBy(F.xxhash64(uid, F.lit(4)), uid)
    return dealt.withColumn(name, F.row_number().over(within) - 1).join(n, [*by, part]).withColumn(name, F.col(name) + F.col(before)).drop(part, before)


def quotas(wanted: list[list[int]], room: list[int]) -> list[list[int]]:
    """Moves from shard i to shard j, at most as wanted, such that no shard gains more than its room: exchanges, then moves into free room."""
    n, room = len(room), list(room)
    out = [[min(wanted[i][j], wanted[j][i]) for j in range(n)] for i in range(n)]
    for _ in range(4 * n):  # what is still refused then asks again in the next round
        for j in range(n):
            for i in sorted(range(n), key=lambda i: out[i][j] - wanted[i][j]):
                more = min(wanted[i][j] - out[i][j], room[j])
                if more > 0:  # what leaves shard i is room there
                    out[i][j], room[j], room[i] = out[i][j] + more, room[j] - more, room[i] + more
    return out


def _homes(m: Column, own: list[Column], room: list[int], slack: list[int], turn: int) -> Column:
    """The shards that a value votes for, from its documents by shard."""
    # room of a full shard: what may leave it in exchange
    each = F.array(*[F.struct(F.least(m, c + max(r, s)).alias("fit"), c.alias("own"), F.xxhash64("key", F.lit(j), F.lit(turn)).alias("tie"), F.lit(j).alias("shard")) for j, (c, r, s) in enumerate(zip(own, room, slack, strict=True))])
    start = F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast("array<int>").alias("homes"))
    add = lambda a, x: F.when(a["sum"] < m, F.struct((a["sum"] + x["fit"]).alias("sum"), F.concat(a["homes"], F.array(x["shard"])).alias("homes"))).otherwise(a)
    return F.aggregate(F.sort_array(each, asc=False), start, add, lambda a: a["homes"])


def _pick(pairs: dict[int, int], code: Column, default: int) -> Column:
    """The number that a few pairs of shards have."""
    return F.coalesce(F.create_map(*[F.lit(x).cast("long") for kv in pairs.items() for x in kv])[code], F.lit(default).cast("long")) if pairs else F.lit(default).cast("long")


def propagate(state: DataFrame, room: list[int], rounds: int, several: bool) -> tuple[DataFrame, list[int]]:
    """state (uid, key, m, salt, shard) after the moves of at most so many rounds, and the room left."""
    n = len(room)
    total = state.select("uid", "shard").distinct() if several else state
    size = {r[0]: r[1] for r in total.groupBy("shard").count().collect()}
    full = [room[j] + size.get(j, 0) for j in range(n)]
    for turn in range(rounds):
        slack = [-(-c // min(1 << turn, 20)) for c in full]  # how much of a full shard others may leave: at first all, as everybody is on the move
        votes = state.groupBy("key", "m").agg(*[F.count_if(F.col("shard") == j).alias(f"own{j}") for j in range(n)])
        votes = votes.select("key", _homes(F.col("m"), [F.col(f"own{j}") for j in range(n)], room, slack, turn).alias("homes"), F.array(*[f"own{j}" for j in range(n)]).alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(m - 1) div {SALT}"))).alias("salt"))
        some = F.get("homes", F.pmod(F.xxhash64("uid", F.lit(turn)), F.size("homes")).cast("int"))
        goal = F.when(F.array_contains("homes", F.col("shard")), F.col("shard")).otherwise(some)
        # values with most documents first, those of one value side by side
        cell = F.expr(f"(40 - cast(floor(log2(m)) as long)) * {1 << 40} + pmod(xxhash64(key, 7), 65536) * {1 << 24} + salt").alias("cell")
        asks = state.join(votes, ["key", "salt"]).select("uid", "shard", goal.alias("goal"), "own", cell)
        if several:  # of its values' homes and where it is, a document asks for the one with most of its neighbours
            asks = asks.groupBy("uid", "shard").agg(F.collect_list(F.struct("goal", "own")).alias("votes"), F.min("cell").alias("cell"))
            near = lambda g: F.aggregate("votes", F.lit(0).cast("long"), lambda a, x: a + F.get(x["own"], g)) - F.when(g == F.col("shard"), F.size("votes")).otherwise(0)
            some = F.array_distinct(F.concat(F.array("shard"), F.transform("votes", lambda x: x["goal"])))
            best = F.array_max(F.transform(some, lambda g: F.struct(near(g).alias("near"), (g == F.col("shard")).alias("here"), F.xxhash64("uid", g).alias("tie"), g.alias("goal"))))
            asks = asks.select("uid", "shard", best["goal"].alias("goal"), "cell")
        wants = cut(asks.filter("goal <> shard").select("uid", "shard", "goal", "cell"))
        wanted = [[0] * n for _ in range(n)]
        for r in wants.groupBy("shard", "goal").count().collect():  # at most a row for each pair of shards
            wanted[r["shard"]][r["goal"]] = r["count"]
        let = quotas(wanted, room)
        if not any(map(sum, let)):
            drop(wants)
            break
        code = (F.col("shard") * n + F.col("goal")).cast("long")
        part = {i * n + j: let[i][j] for i in range(n) for j in range(n) if 0 < let[i][j] < wanted[i][j]}
        upto, take = {i * n + j: 1 << 62 for i in range(n) for j in range(n) if let[i][j] == wanted[i][j]}, {}
        if part:
            cells = wants.filter(code.isin(*part)).groupBy("shard", "goal", "cell").agg(F.count(F.lit(1)).alias("k"))
            cells = cells.withColumn("sum", F.sum("k").over(Window.partitionBy("shard", "goal").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)))
            quota = _pick(part, code, 0)
            for r in cells.filter((F.col("sum") >= quota) & (F.col("sum") - F.col("k") < quota)).collect():  # one for each pair of shards
                at = r["shard"] * n + r["goal"]
                upto[at], take[at] = r["cell"], part[at] - (r["sum"] - r["k"])
        last = _pick(upto, code, -1)
        moved = wants.filter(F.col("cell") < last).select("uid", "goal")
        if take:
            in_cell = Window.partitionBy("shard", "goal", "cell").orderBy(F.xxhash64("uid", F.lit(5)), "uid")
            moved = moved.union(wants.filter(F.col("cell") == last).withColumn("r", F.row_number().over(in_cell)).filter(F.col("r") <= _pick(take, code, 0)).select("uid", "goal"))
        before, state = state, cut(state.join(moved, "uid", "left").withColumn("shard", F.coalesce("goal", "shard")).drop("goal"))
        drop(before)
        drop(wants)
        room = [room[j] + sum(let[j]) - sum(let[i][j] for i in range(n)) for j in range(n)]
    return state, room


def assign(docs: DataFrame, shards: int = 8, rounds: int = 12, keys: Sequence[Column] | None = None) -> DataFrame:
    """doc_id, size (UTF-8 bytes and 1), text_crc32, law, shard and slot (without gaps from 0 within the shard) of each row of docs (doc_id, text).

    keys: what links documents, as expressions over docs; by default the text. shards: up to about 100, as counts by pair of shards are literals.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    several = keys is not None and len(keys) > 1
    digest = [F.unhex(F.md5(k.cast("string"))) for k in (keys if keys is not None else [text])]
    digest = [F.concat(d, F.lit(bytearray([i]))) for i, d in enumerate(digest)] if several else digest
    base = cut(docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.array_compact(F.array(*digest)).alias("keys")))
    total = base.count()

    member = base.select("uid", F.explode("keys").alias("key"))
    many = cut(member.groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter("m > 1"))
    salts = f"(m + {SALT - 1}) div {SALT}"
    hot = many.filter(F.col("m") > SALT).select("key", F.expr(salts).alias("salts"))
    salted = member.join(hot, "key", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("uid"), F.col("salts")), F.lit(0).cast("long"))).drop("salts")
    linked = cut(salted.join(many.withColumn("salt", F.explode(F.expr(f"sequence(0L, {salts} - 1)"))), ["key", "salt"]).select("uid", "key", "m", "salt"))

    start = linked.select("uid").distinct() if several else linked.select("uid")
    first = numbered(start, [], "uid", "n").select("uid", (F.col("n") % shards).cast("int").alias("shard"))
    state = cut(linked.join(first, "uid"))
    n_linked = start.count()
    seats = lambda n: [n // shards + (j < n % shards) for j in range(shards)]
    capacity = seats(total)
    state, room = propagate(state, [c - s for c, s in zip(capacity, seats(n_linked), strict=True)], rounds, several)
    placed = cut(state.select("uid", "shard").distinct() if several else state.select("uid", "shard"))
    drop(linked)

    ends = [sum(room[: j + 1]) for j in range(shards)]
    alone = numbered(base.select("uid").join(placed, "uid", "left_anti"), [], "uid", "n")
    shard = F.coalesce(*[F.when(F.col("n") < e, j) for j, e in enumerate(ends)])
    offset = F.get(F.array(*[F.lit(c - r - (e - r)).cast("long") for c, r, e in zip(capacity, room, ends, strict=True)]), F.col("shard"))
    alone = alone.withColumn("shard", shard).select("uid", "shard", (F.col("n") + offset).alias("slot"))
    every = numbered(placed, ["shard"], "uid", "slot").select("uid", "shard", F.col("slot").cast("long").alias("slot")).union(alone)
    return base.join(every, "uid").select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot")
