"""Which image a capture belongs to, each image once; which telemetry sources a mission means.

Captures choose in their order, an image that an earlier capture has is gone. That is settled for all captures at a time: with what is known of who took
which image, each capture chooses among the images that no earlier one took; what they choose is what is known in the next
round. The first captures are right after one round, whoever depends on them after the next, and nobody changes in the last. Images
of one index or name are never paired with its captures: a window over both, by the time of taking, tells each capture what is left.

Most captures of a long mission cannot get any image, whatever the others take, as so many before them asked for the same few. They are told
apart by their places among those who ask for the same, and take no part in the rounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evifuse.sources.scratch import written

NEVER = (1 << 63) - 1
#: Groups that captures without an index or a name are dealt to.
DEALT = 256
CONFLICT, UNMATCHED = "capture_index_conflicts_with_file", "no_unique_image_match"


def left_over(captures: DataFrame, images: DataFrame, keys: list[str], by: list[str], name: str) -> DataFrame:
    """Captures (keys, order) with ``name`` as (n, position): images that agree in ``by`` and are not taken before: how many, the first; and (all) how many there are."""
    known = F.lit(True)
    for c in by:
        known &= F.col(c).isNotNull()
    none = F.lit(None).cast("long")
    own = images.where(known).select(*keys, *by, F.col("taken").alias("time"), "position", none.alias("order"))
    asked = captures.where(known).select(*keys, *by, F.col("order").alias("time"), none.alias("position"), "order")
    group = Window.partitionBy(*keys, *by)
    free = group.orderBy(F.desc("time")).rangeBetween(Window.unboundedPreceding, 0)
    found = own.unionByName(asked).select(*keys, "order", F.struct(F.count("position").over(free).alias("n"), F.min("position").over(free).alias("position"),
        F.count("position").over(group).alias("all")).alias(name))
    return found.where("order IS NOT NULL")


def asked(captures: DataFrame, images: DataFrame, keys: list[str], by: list[str], counted: Column, name: str) -> DataFrame:
    """Adds ``name`` as (all, place): images that agree in ``by``, and how many ``counted`` captures up to and with this one ask for them. Captures without a value are dealt by order."""
    known = F.lit(True)
    for c in by:
        known &= F.col(c).isNotNull()
    own = images.where(known).select(*keys, *by, F.lit(1).alias("_image"))
    both = captures.unionByName(own, allowMissingColumns=True).withColumn("_deal", F.when(known, 0).otherwise(F.pmod(F.xxhash64("order"), F.lit(DEALT))))
    so_far = Window.partitionBy(*keys, *by, "_deal").orderBy(F.asc_nulls_first("order")).rowsBetween(Window.unboundedPreceding, 0)  # images come first
    held = both.withColumn(name, F.struct(F.count("_image").over(so_far).alias("all"), F.count(F.when(F.col("order").isNotNull() & counted, 1)).over(so_far).alias("place")))
    return held.where("order IS NOT NULL").drop("_image", "_deal")


def contenders(captures: DataFrame, images: DataFrame, keys: list[str], strict: bool) -> DataFrame:
    """Captures with some, index, named (strictly: both) and ``may``: whether they can get an image at all.

    Whoever asks takes one of the group's images if any is left, so after as many captures as images nobody gets one: those of an index, then those of a
    name who certainly get none by index. Strictly a group of several may have one left at any time; of one image only the first asks.
    """
    ends = images.groupBy(*keys).agg(F.max("position").alias("last"), F.lit(True).alias("some"))
    by_index, by_name = F.col("image_index").isNotNull(), F.col("name").isNotNull()
    first = lambda g: F.col(f"{g}.place") <= F.col(f"{g}.all")
    if not strict:
        rows = asked(captures, images, keys, ["image_index"], F.lit(True), "index")
        rows = asked(rows, images, keys, ["name"], ~first("index"), "named").join(ends, keys, "left")
        may = first("index") | first("named") | F.coalesce(F.col("order") <= F.col("last"), F.lit(False))
    else:
        rows = asked(captures, images, keys, ["image_index"], ~by_name, "index")
        rows = asked(rows, images, keys, ["name"], ~by_index, "named")
        rows = asked(rows, images, keys, ["image_index", "name"], F.lit(True), "both").join(ends, keys, "left")
        open_ = lambda g: (F.col(f"{g}.all") > 1) | ((F.col(f"{g}.all") == 1) & (F.col(f"{g}.place") == 1))
        may = F.when(by_index & by_name, open_("both")).when(by_index, open_("index")).when(by_name, open_("named")).otherwise(False)
    return rows.withColumn("may", may).drop("last")


def match(captures: DataFrame, images: DataFrame, keys: list[str], strict: bool) -> DataFrame:
    """keys, order, position, basis, image, reason for captures (keys, order, image_index, file) and images (keys, position, image_index, file).

    order counts a key's captures from 0, position its images. Strictly, an image must agree in all that the capture states, and be the only one left.
    Otherwise the first image left by index, then by file name, then the one in the capture's own place is taken, and without any a name is
    made up. Names are compared in lower case. A key without images takes made-up names either way. Keys are not null.
    """
    pictures = written(images.select(*keys, "position", "image_index", F.lower("file").alias("name"), F.col("file").alias("image")), "images")
    every = written(contenders(captures.select(*keys, "order", "image_index", F.lower("file").alias("name"), "file"), pictures, keys, strict), "captures")
    events = written(every.where("may").select(*keys, "order", "image_index", "name", "file", "some"), "captures-contending")
    taken, known = pictures.select(*keys, "position").limit(0).withColumn("taken", F.lit(None).cast("long")), None
    by_index, by_name = F.col("image_index").isNotNull(), F.col("name").isNotNull()
    groups = {"both": (["image_index", "name"], by_index & by_name), "index": (["image_index"], by_index & ~by_name), "named": (["name"], by_name & ~by_index)}
    out = [*keys, "order", "image_index", "file", "position", "basis", "reason"]
    while True:
        free = pictures.join(taken, [*keys, "position"], "left").withColumn("taken", F.coalesce("taken", F.lit(NEVER)))
        rows = events
        for name, (by, own) in groups.items():
            if strict or name != "both":
                rows = rows.join(left_over(events.where(own) if strict else events, free, keys, by, name), [*keys, "order"], "left")
        own = free.select(*keys, F.col("position").alias("order"), F.col("taken").alias("placed"))
        rows = rows.join(own, [*keys, "order"], "left").withColumn("placed", F.when(F.col("placed") >= F.col("order"), F.col("order")))
        chosen = written((_strictly(rows) if strict else _freely(rows)).select(*out), "image-matches")
        taken = written(chosen.where("position IS NOT NULL").groupBy(*keys, "position").agg(F.min("order").alias("taken")), "images-taken")
        mark = taken.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*keys, "position", "taken").cast("decimal(20,0)"))).first()
        if mark == known:
            break
        known = mark
    made_up = F.format_string("image_%06d.jpg", F.coalesce("image_index", "order"))
    named = chosen.join(pictures.select(*keys, "position", "image"), [*keys, "position"], "left")
    none = {c: F.struct(F.lit(0).alias("n"), F.lit(None).cast("long").alias("position"), F.col(f"{c}.all").alias("all")) for c in groups if strict or c != "both"}
    rest = every.where("NOT may").withColumns({**none, "placed": F.lit(None).cast("long")})
    rest = (_strictly(rest) if strict else _freely(rest)).select(*out).withColumn("image", F.lit(None).cast("string"))
    named = named.select(*out, "image").unionByName(rest)
    return named.select(*keys, "order", "position", "basis", F.coalesce("image", F.when(F.col("reason").isNull(), F.coalesce("file", made_up))).alias("image"), "reason")


def _made_up() -> Column:
    return F.when(F.col("file").isNotNull(), "event_file_url").otherwise("generated_event_index")


def _freely(rows: DataFrame) -> DataFrame:
    steps = {"image_index": F.col("index.position"), "file_url": F.col("named.position"), "list_order_fallback": F.col("placed")}
    basis = F.coalesce(*(F.when(p.isNotNull(), name) for name, p in steps.items()), _made_up())
    return rows.withColumns({"position": F.coalesce(*steps.values()), "basis": basis, "reason": F.lit(None).cast("string")})


def _strictly(rows: DataFrame) -> DataFrame:
    by_index, by_name = F.col("image_index").isNotNull(), F.col("file").isNotNull()
    basis = F.when(by_index & by_name, "both").when(by_index, "index").when(by_name, "named")
    conflict = by_index & by_name & (F.col("index.all") > 0) & (F.col("named.all") > 0) & (F.coalesce("both.all", F.lit(0)) == 0)
    n, position = (F.coalesce(*(F.when(basis == g, F.col(f"{g}.{what}")) for g in ("both", "index", "named"))) for what in ("n", "position"))
    some = F.coalesce("some", F.lit(False))
    reason = F.when(some & F.coalesce(conflict, F.lit(False)), CONFLICT).when(some & (F.coalesce(n, F.lit(0)) != 1), UNMATCHED)
    named = F.when(basis == "both", "image_index+file_url").when(basis == "index", "image_index").when(basis == "named", "file_url")
    return rows.withColumns({"reason": reason, "position": F.when(some & reason.isNull(), position), "basis": F.when(~some, _made_up()).when(reason.isNull(), named)})


#: Message types that tell of captures, of poses, and of a receiver's quality.
CAPTURES, POSES, RECEIVERS = ("CAMERA_IMAGE_CAPTURED", "CAMERA_TRIGGER"), ("GLOBAL_POSITION_INT", "ATTITUDE_QUATERNION"), ("GPS_RAW_INT", "GPS2_RAW")


def sources(messages: DataFrame, system: int | None = None, camera: int | None = None, capture_component: int | None = None, navigation_component: int | None = None,
    gps_type: str | None = None, trigger_camera: int | None = None) -> DataFrame:
    """mission, system, camera, component, reason: the one source of each kind that a mission's messages (mission, kind, system, component, camera) come from, or why there
    is no one. Selectors, where given, choose among several. Only the distinct sources of a mission meet in a row; a system or component that a message does not name is null.
    """
    own = F.coalesce("camera", F.when(F.col("kind") == "CAMERA_TRIGGER", F.lit(trigger_camera).cast("long")))
    distinct = messages.select("mission", "kind", "system", "component", F.when(F.col("kind").isin(*CAPTURES), own).alias("camera")).distinct()
    rows = distinct.groupBy("mission").agg(F.collect_list(F.struct("kind", "system", "component", "camera")).alias("all"))
    of = lambda x, kinds: x["kind"].isin(*kinds)

    def one(rows: DataFrame, name: str, selector: int | None, kinds: tuple[str, ...] | None, several: str, none: str | None) -> DataFrame:
        """Narrows ``all`` to one value of a field among messages of the kinds; adds it by name, and the reasons."""
        field = name if name != "capture_component" else "component"
        mine = (lambda x: of(x, kinds)) if kinds else (lambda x: F.lit(True))
        values = F.array_distinct(F.filter(F.transform(F.filter("all", mine), lambda x: x[field]), lambda v: v.isNotNull()))
        rows = rows.withColumn("_v", values)
        chosen = F.lit(selector).cast("long") if selector is not None else F.when(F.size("_v") == 1, F.element_at("_v", 1))
        rows = rows.withColumn(name, chosen)
        # what is of another kind stays, what does not name the chosen source goes
        narrowed = F.when(F.col(name).isNull(), F.col("all")).otherwise(F.filter("all", lambda x: ~mine(x) | F.coalesce(x[field] == F.col(name), F.lit(False))))
        rows = rows.withColumn("all", narrowed)
        gone = F.lit(False) if none is None else F.col(name).isNotNull() & (F.size(F.filter("all", mine)) == 0)
        failing = F.when(F.lit(selector is None) & (F.size("_v") > 1), several).when(gone, none)
        return rows.withColumn("reason", F.coalesce("reason", failing)).drop("_v")

    rows = rows.withColumn("reason", F.lit(None).cast("string"))
    rows = one(rows, "system", system, None, "several_systems", "no_messages_of_system")
    rows = one(rows, "camera", camera, CAPTURES, "several_cameras", None)
    rows = one(rows, "capture_component", capture_component, CAPTURES, "several_capture_components", "no_captures_of_component")
    poses = F.filter("all", lambda x: of(x, POSES))
    if navigation_component is None:
        found = F.array_distinct(F.transform(poses, lambda x: F.struct(x["system"].alias("s"), x["component"].alias("c"))))
        failing = F.when(F.size(found) > 1, "several_navigation_sources")
    else:
        mine = F.filter(poses, lambda x: F.coalesce(x["component"] == navigation_component, F.lit(False)))
        failing = F.when((F.size(poses) > 0) & (F.size(mine) == 0), "no_telemetry_of_component")
    rows = rows.withColumn("reason", F.coalesce("reason", failing))
    receivers = F.filter("all", lambda x: of(x, RECEIVERS) if gps_type is None else x["kind"] == gps_type)
    receiving = F.array_distinct(F.transform(receivers, lambda x: F.struct(x["kind"].alias("k"), x["system"].alias("s"), x["component"].alias("c"))))
    rows = rows.withColumn("reason", F.coalesce("reason", F.when(F.size(receiving) > 1, "several_gps_sources")))
    return rows.select("mission", "system", "camera", "capture_component", "reason")


def of_sources(messages: DataFrame, chosen: DataFrame, navigation_component: int | None = None, gps_type: str | None = None, trigger_camera: int | None = None) -> DataFrame:
    """The messages that come from their mission's chosen sources; none of a mission with a reason."""
    picked = chosen.where("reason IS NULL").select("mission", F.col("system").alias("_s"), F.col("camera").alias("_c"), F.col("capture_component").alias("_p"))
    kind, same = F.col("kind"), lambda c, v: F.col(v).isNull() | F.coalesce(c == F.col(v), F.lit(False))
    own = F.coalesce("camera", F.when(kind == "CAMERA_TRIGGER", F.lit(trigger_camera).cast("long")))
    kept = same(F.col("system"), "_s") & (~kind.isin(*CAPTURES) | same(own, "_c") & same(F.col("component"), "_p"))
    if navigation_component is not None:
        kept &= ~kind.isin(*POSES) | F.coalesce(F.col("component") == navigation_component, F.lit(False))
    if gps_type is not None:
        kept &= ~kind.isin(*RECEIVERS) | (kind == gps_type)
    return messages.join(picked, "mission").where(kept).drop("_s", "_c", "_p")
