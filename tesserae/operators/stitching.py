"""Rooms placed in one frame: rigid moves composed along spanning trees, least squares where moves close
circles, walls turned onto the axes.

A move (x, y, yaw) of an edge (a, b) is the pose of b in a's frame. Nothing here takes a component into one task:
trees are joined by hooks and pointer jumps, and equations are solved by sums over edges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions.geometry import rotated, wrapped
from tesserae.session import Steps

Move = tuple[Column, Column, Column]


def move(prefix: str = "") -> Move:
    return F.col(f"{prefix}x"), F.col(f"{prefix}y"), F.col(f"{prefix}yaw")


def after(outer: Move, inner: Move) -> Move:
    """The pose that inner has in the frame in which outer is the pose of inner's frame."""
    x, y = rotated(inner[0], inner[1], outer[2])
    return outer[0] + x, outer[1] + y, wrapped(outer[2] + inner[2])


def undone(m: Move) -> Move:
    """The pose of the frame in which m is a pose, seen from there."""
    x, y = rotated(-m[0], -m[1], -m[2])
    return x, y, wrapped(-m[2])


def named(m: Move, prefix: str = "") -> list[Column]:
    return [c.alias(f"{prefix}{n}") for c, n in zip(m, ("x", "y", "yaw"))]


def both_ways(edges: DataFrame) -> DataFrame:
    """(a, b, x, y, yaw, weight) with every edge from either end; edges of a node with itself go."""
    there = edges.filter("a <> b").select("a", "b", *named(move()), "weight")
    return there.union(there.select("b", "a", *named(undone(move())), "weight"))


def spanning_poses(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes (node), edges (a, b, x, y, yaw, weight) to (node, component, x, y, yaw): the pose of every
    node in the frame of the least node of its component, along a tree of edges.

    In every round each tree hooks by its heaviest edge to the least tree beside it, trees flatten by pointer jumping
    with their moves composed, and edges become moves between the new trees. Trees at least halve in number, so
    rounds grow with the logarithm of the nodes. Ends that are not in nodes have no part; null ends neither."""
    steps = Steps(edges.sparkSession)
    still = [F.lit(0.0).alias(c) for c in ("x", "y", "yaw")]
    poses = steps.keep(nodes.select("node").filter("node is not null").distinct().select("node", F.col("node").alias("tree"), *still), "poses")
    known = lambda end: poses.select(F.col("node").alias(end))
    between = steps.keep(both_ways(edges).join(known("a"), "a", "left_semi").join(known("b"), "b", "left_semi"), "edges")
    while between.limit(1).count():
        first = F.min_by(F.struct("a", *named(move())), F.struct(F.col("a"), -F.col("weight"), *named(move())))
        hooks = between.groupBy(F.col("b").alias("tree")).agg(first.alias("h")).select("tree", F.col("h.a").alias("up"), "h.x", "h.y", "h.yaw")
        back = hooks.select(F.col("tree").alias("t"), F.col("up").alias("back"))
        top = (F.col("back") == F.col("tree")) & (F.col("tree") < F.col("up"))  # two that hook to each other: the lesser stays
        hooks = hooks.join(back, F.col("up") == F.col("t")).select("tree", F.when(top, F.col("tree")).otherwise(F.col("up")).alias("up"), *[F.when(top, 0.0).otherwise(c).alias(n) for c, n in zip(move(), ("x", "y", "yaw"))])
        hooks = steps.keep(hooks, "hooks")
        while True:
            over = hooks.select(F.col("tree").alias("t"), F.col("up").alias("jump"), *named(move(), "over_"))
            jumped = hooks.join(over, F.col("up") == F.col("t")).select("tree", F.col("jump").alias("up"), *named(after(move("over_"), move())), (F.col("jump") != F.col("up")).alias("moved"))
            jumped = steps.keep(jumped, "jumps")
            moved = jumped.filter("moved").limit(1).count()
            hooks = jumped.drop("moved")
            if not moved:
                break
        to = hooks.select(F.col("tree").alias("t"), "up", *named(move(), "up_"))
        joined = poses.join(to, F.col("tree") == F.col("t"), "left")
        new = after(move("up_"), move())
        poses = steps.keep(joined.select("node", F.coalesce("up", "tree").alias("tree"), *[F.when(F.col("t").isNull(), old).otherwise(c).alias(n) for old, c, n in zip(move(), new, ("x", "y", "yaw"))]), "poses")
        for end in ("a", "b"):
            between = between.join(hooks.select(F.col("tree").alias(end), F.col("up").alias(f"to_{end}"), *named(move(), f"{end}_")), end)
        outer = after(after(move("a_"), move()), undone(move("b_")))
        between = steps.keep(between.filter("to_a <> to_b").select(F.col("to_a").alias("a"), F.col("to_b").alias("b"), *named(outer), "weight"), "edges")
    anchor = poses.groupBy(F.col("tree").alias("t")).agg(F.min_by(F.struct("node", *named(move())), "node").alias("r"))
    anchor = anchor.select("t", F.col("r.node").alias("component"), F.col("r.x").alias("r_x"), F.col("r.y").alias("r_y"), F.col("r.yaw").alias("r_yaw"))
    seen = poses.join(anchor, F.col("tree") == F.col("t"))
    return seen.select("node", "component", *named(after(undone(move("r_")), move())))


def least_squares(nodes: DataFrame, edges: DataFrame, wanted: list[str], most: int = 500, small: float = 1e-9) -> DataFrame:
    """(node, component, wanted): values whose differences b - a come nearest to the edges' wanted ones, by weighted
    squares, with 0 at every component's node of its own name.

    nodes (node, component), edges (a, b, weight, wanted). Conjugate gradients over all components at once: a step sums
    over edges for each node and over nodes for each component. Ends when no residual is above `small` of what it began with;
    an error after `most` steps."""
    steps = Steps(edges.sparkSession)
    edges = steps.keep(edges.select("a", "b", "weight", *wanted), "edges")
    dims = range(len(wanted))
    total = lambda name: sum((F.col(f"{name}{i}") * F.col(f"{name}{i}") for i in dims), start=F.lit(0.0))

    def sums(values: list[Column], rows: DataFrame) -> DataFrame:
        """For each node, minus the values of edges that leave it and plus those of edges that reach it."""
        ends = F.array(*[F.struct(F.col(end).alias("node"), *[(sign * v).alias(f"s{i}") for i, v in enumerate(values)]) for end, sign in (("a", -1), ("b", 1))])
        return rows.select(F.explode(ends).alias("e")).select("e.*").groupBy("node").agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in dims])

    free = F.col("node") != F.col("component")
    right = sums([F.col("weight") * F.col(w) for w in wanted], edges)
    start = nodes.select("node", "component").join(right, "node", "left")
    rest = [F.when(free, F.coalesce(f"s{i}", F.lit(0.0))).otherwise(0.0) for i in dims]
    state = start.select("node", "component", *[F.lit(0.0).alias(f"v{i}") for i in dims], *[r.alias(f"r{i}") for i, r in enumerate(rest)], *[r.alias(f"p{i}") for i, r in enumerate(rest)])
    state = steps.keep(state, "state")
    first = state.agg(F.max(total("r"))).first()[0] or 0.0
    for _ in range(most):
        if (state.agg(F.max(total("r"))).first()[0] or 0.0) <= small * small * first:
            return state.select("node", "component", *[F.col(f"v{i}").alias(w) for i, w in enumerate(wanted)])
        at = lambda end: state.select(F.col("node").alias(end), *[F.col(f"p{i}").alias(f"{end}{i}") for i in dims])
        flow = edges.join(at("a"), "a").join(at("b"), "b")
        pulled = sums([F.col("weight") * (F.col(f"b{i}") - F.col(f"a{i}")) for i in dims], flow)
        joined = state.join(pulled, "node", "left").select(*state.columns, *[F.when(free, F.coalesce(f"s{i}", F.lit(0.0))).otherwise(0.0).alias(f"q{i}") for i in dims])
        joined = steps.keep(joined, "pulled")
        ratio = joined.groupBy(F.col("component").alias("c")).agg(*[x for i in dims for x in (F.sum(F.col(f"r{i}") * F.col(f"r{i}")).alias(f"rr{i}"), F.sum(F.col(f"p{i}") * F.col(f"q{i}")).alias(f"pq{i}"))])
        pace = lambda i: F.coalesce(F.try_divide(f"rr{i}", f"pq{i}"), F.lit(0.0))
        gone = joined.join(ratio, F.col("component") == F.col("c")).select("node", "component", *[(F.col(f"v{i}") + pace(i) * F.col(f"p{i}")).alias(f"v{i}") for i in dims], *[(F.col(f"r{i}") - pace(i) * F.col(f"q{i}")).alias(f"r{i}") for i in dims], *[f"p{i}" for i in dims], *[f"rr{i}" for i in dims])
        gone = steps.keep(gone, "gone")
        now = gone.groupBy(F.col("component").alias("c")).agg(*[F.sum(F.col(f"r{i}") * F.col(f"r{i}")).alias(f"now{i}") for i in dims])
        turned = [(F.col(f"r{i}") + F.coalesce(F.try_divide(f"now{i}", f"rr{i}"), F.lit(0.0)) * F.col(f"p{i}")).alias(f"p{i}") for i in dims]
        state = steps.keep(gone.join(now, F.col("component") == F.col("c")).select("node", "component", *[f"v{i}" for i in dims], *[f"r{i}" for i in dims], *turned), "state")
    raise ValueError(f"least squares did not settle in {most} steps")


def relaxed_poses(poses: DataFrame, edges: DataFrame) -> DataFrame:
    """poses (spanning_poses) after all edges have had their say: first the yaws, then, with these, the places, each by
    weighted least squares. Components whose edges form trees are met exactly and stay as they are."""
    steps = Steps(edges.sparkSession)
    poses = steps.keep(poses, "poses")
    of = lambda end: poses.select(F.col("node").alias(end), F.col("component").alias(f"{end}_c"), *named(move(), f"{end}_"))
    inner = steps.keep(edges.filter("a <> b").join(of("a"), "a").join(of("b"), "b").withColumnRenamed("a_c", "component"), "edges")
    number = inner.groupBy("component").agg(F.count(F.lit(1)).alias("m")).join(poses.groupBy("component").agg(F.count(F.lit(1)).alias("n")), "component").filter("m >= n").select("component")
    circled = steps.keep(poses.join(number, "component", "left_semi"), "circled")
    if not circled.limit(1).count():
        return poses
    inner = inner.join(number, "component", "left_semi")
    turn = inner.select("a", "b", "weight", wrapped(F.col("yaw") - (F.col("b_yaw") - F.col("a_yaw"))).alias("turn"))
    turns = least_squares(circled.select("node", "component"), turn, ["turn"])
    turned = steps.keep(circled.join(turns.select("node", "turn"), "node").select("node", "component", "x", "y", wrapped(F.col("yaw") + F.col("turn")).alias("yaw")), "turned")
    now = inner.select("a", "b", "weight", "x", "y").join(turned.select(F.col("node").alias("a"), F.col("yaw").alias("at")), "a")
    dx, dy = rotated(F.col("x"), F.col("y"), F.col("at"))
    places = least_squares(circled.select("node", "component"), now.select("a", "b", "weight", dx.alias("x"), dy.alias("y")), ["x", "y"])
    solved = places.join(turned.select("node", "yaw"), "node").select("node", "component", "x", "y", "yaw")
    return poses.join(number, "component", "left_anti").select("node", "component", "x", "y", "yaw").unionByName(solved)


def snapped(poses: DataFrame, walls: DataFrame, room: str) -> DataFrame:
    """poses turned, each component as one, so that its walls (room, ax, ay, bx, by in the room's frame) lie along the axes:
    by the circular mean of their directions modulo a right angle, weighted by length. Without walls nothing turns."""
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    long = F.sqrt(dx * dx + dy * dy)
    angle = 4 * (F.atan2(dy, dx) + F.col("yaw"))
    mean = walls.join(poses, F.col(room) == F.col("node")).groupBy("component").agg(F.sum(long * F.sin(angle)).alias("s"), F.sum(long * F.cos(angle)).alias("c"))
    mean = mean.select(F.col("component").alias("m"), (-F.atan2("s", "c") / 4).alias("turn"))
    joined = poses.join(mean, F.col("component") == F.col("m"), "left").withColumn("turn", F.coalesce("turn", F.lit(0.0)))
    x, y = rotated(F.col("x"), F.col("y"), F.col("turn"))
    return joined.select("node", "component", x.alias("x"), y.alias("y"), wrapped(F.col("yaw") + F.col("turn")).alias("yaw"))


def in_frame(points: DataFrame, poses: DataFrame, room: str) -> DataFrame:
    """points (room, x, y in the room's frame, more) with component, and x and y in the component's frame."""
    at = poses.select(F.col("node").alias(room), "component", *named(move(), "at_"))
    x, y = rotated(F.col("x"), F.col("y"), F.col("at_yaw"))
    rest = [c for c in points.columns if c not in (room, "x", "y")]
    return points.join(at, room).select(room, "component", *rest, (F.col("at_x") + x).alias("x"), (F.col("at_y") + y).alias("y"))
