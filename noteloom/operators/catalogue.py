"""The navigation catalogue: wings, rooms, drawers, halls and tunnels.

wings (name, type, keywords); rooms (wing, room); drawers (wing, room, path, ord); halls (wing, room, hall_type, content);
tunnels (id, wing_a, wing_b, room, hall_a, hall_b). The state after a log of operations is found with aggregates and windows:
creating a wing or room again wipes what was in it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S

from ..functions import text as T

# The kinds of halls, and a tunnel's default ends.
HALLS = ["hall_facts", "hall_events", "hall_discoveries", "hall_preferences", "hall_advice"]
HALL_A, HALL_B = "hall_events", "hall_facts"

_ROOM = S.StructType([S.StructField("name", S.StringType()), S.StructField("drawers", S.ArrayType(S.StringType())),
                      S.StructField("halls", S.MapType(S.StringType(), S.StringType()))])
DOCUMENT = S.StructType([
    S.StructField("wings", S.MapType(S.StringType(), S.StructType([
        S.StructField("name", S.StringType()), S.StructField("type", S.StringType()), S.StructField("keywords", S.ArrayType(S.StringType())),
        S.StructField("rooms", S.MapType(S.StringType(), _ROOM))]))),
    S.StructField("tunnels", S.ArrayType(S.StructType([S.StructField(x, S.StringType()) for x in ("id", "wing_a", "wing_b", "room", "hall_a", "hall_b")]))),
])


@dataclass
class Catalogue:
    wings: DataFrame
    rooms: DataFrame
    drawers: DataFrame
    halls: DataFrame
    tunnels: DataFrame


def from_document(doc: DataFrame) -> Catalogue:
    """The five frames of a catalogue document (a row of DOCUMENT)."""
    w = doc.select(F.explode("wings").alias("wing", "w"))
    r = w.select("wing", F.explode("w.rooms").alias("room", "r"))
    tunnels = doc.select(F.explode("tunnels").alias("t")).select("t.*")
    return Catalogue(
        w.select(F.col("wing").alias("name"), "w.type", "w.keywords"), r.select("wing", "room"),
        r.select("wing", "room", F.posexplode("r.drawers").alias("ord", "path")).select("wing", "room", "path", "ord"),
        r.select("wing", "room", F.explode("r.halls").alias("hall_type", "content")), tunnels)


def to_document(c: Catalogue) -> DataFrame:
    """One row of DOCUMENT. A catalogue is small (it names folders), so its one document is put together in one row."""
    entries = lambda key, value: F.map_from_entries(F.collect_list(F.struct(key, value)))
    drawers = c.drawers.groupBy("wing", "room").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "path"))), lambda x: x.path).alias("drawers"))
    halls = c.halls.groupBy("wing", "room").agg(entries(F.col("hall_type"), F.col("content")).alias("halls"))
    rooms = c.rooms.join(drawers, ["wing", "room"], "left").join(halls, ["wing", "room"], "left")
    room = F.struct(F.col("room").alias("name"), F.coalesce("drawers", F.array().cast("array<string>")).alias("drawers"),
                    F.coalesce("halls", F.create_map().cast("map<string,string>")).alias("halls"))
    by_wing = rooms.groupBy("wing").agg(entries(F.col("room"), room).alias("rooms"))
    wing = F.struct("name", "type", "keywords", "rooms")
    wings = c.wings.join(by_wing, c.wings.name == by_wing.wing, "left").agg(entries(F.col("name"), wing).alias("wings"))
    return wings.join(c.tunnels.agg(F.collect_list(F.struct(*c.tunnels.columns)).alias("tunnels")))


def replay(ops: DataFrame) -> Catalogue:
    """The catalogue after ops (seq, op, wing, room, path, hall_type, content, type, keywords, wing_b, hall_a, hall_b).

    op: create_wing, create_room, link_drawer, add_hall, create_tunnel. A wing made again loses its rooms; a room made again its
    drawers and halls; rooms and drawers make what they need; halls of unknown kind or without their room don't count; of tunnels
    with one id the first counts."""
    wing_reset = ops.where("op = 'create_wing'").groupBy("wing").agg(
        F.max("seq").alias("w_seq"), F.max_by(F.struct(F.coalesce("type", F.lit("project")).alias("type"), F.coalesce("keywords", F.array().cast("array<string>")).alias("keywords")), "seq").alias("w"))
    makes = ops.where("op in ('create_room', 'link_drawer')")
    names = ops.where("op in ('create_wing', 'create_room', 'link_drawer')").select("wing").distinct()
    wings = names.join(wing_reset, "wing", "left").select(
        F.col("wing").alias("name"), F.coalesce("w.type", F.lit("project")).alias("type"), F.coalesce("w.keywords", F.array().cast("array<string>")).alias("keywords"))
    live = makes.join(wing_reset.select("wing", "w_seq"), "wing", "left").where("w_seq is null or seq > w_seq")
    rooms = live.select("wing", "room").distinct()
    # a room is wiped when it is created; a drawer creates it only if it isn't there
    room_reset = live.groupBy("wing", "room").agg(F.max(F.when(F.col("op") == "create_room", F.col("seq"))).alias("r_seq"), F.min("seq").alias("made"), F.first("w_seq").alias("w_seq"))
    drawers = live.where("op = 'link_drawer'").join(room_reset.select("wing", "room", "r_seq"), ["wing", "room"]).where("r_seq is null or seq > r_seq")
    first = drawers.groupBy("wing", "room", "path").agg(F.min("seq").alias("seq"))
    place = F.row_number().over(Window.partitionBy("wing", "room").orderBy("seq")) - 1
    halls = ops.where(F.col("hall_type").isin(HALLS) & (F.col("op") == "add_hall")).join(room_reset, ["wing", "room"]).where("seq > made and (r_seq is null or seq > r_seq)")
    halls = halls.groupBy("wing", "room", "hall_type").agg(F.max_by("content", "seq").alias("content"))
    tunnels = ops.where("op = 'create_tunnel'").withColumn("id", F.concat_ws(":", "wing", "wing_b", "room"))
    t = tunnels.groupBy("id").agg(F.min_by(F.struct(
        F.col("wing").alias("wing_a"), "wing_b", "room", F.coalesce("hall_a", F.lit(HALL_A)).alias("hall_a"), F.coalesce("hall_b", F.lit(HALL_B)).alias("hall_b")), "seq").alias("t"))
    return Catalogue(wings, rooms, first.withColumn("ord", place).select("wing", "room", "path", "ord"), halls, t.select("id", "t.*"))


def build(notes: DataFrame) -> Catalogue:
    """The catalogue of a vault: a room and drawer for each note right in brain/ and work/active/, a wing for each in org/people/."""
    parts = T.path_parts("rel_path")
    placed = notes.withColumn("_parts", parts).select(
        F.when((F.size("_parts") == 2) & (F.get("_parts", F.lit(0)) == "brain"), F.struct(F.lit("brain").alias("wing"), T.slug("stem").alias("room"), F.lit("project").alias("type")))
        .when((F.size("_parts") == 3) & (F.get("_parts", F.lit(0)) == "work") & (F.get("_parts", F.lit(1)) == "active"),
              F.struct(F.lit("work").alias("wing"), T.slug("stem").alias("room"), F.lit("project").alias("type")))
        .when((F.size("_parts") == 3) & (F.get("_parts", F.lit(0)) == "org") & (F.get("_parts", F.lit(1)) == "people"),
              F.struct(F.col("stem").alias("wing"), F.lit("context").alias("room"), F.lit("person").alias("type"))).alias("p"),
        "rel_path").where("p is not null").select("p.*", F.col("rel_path").alias("path"))
    spark = notes.sparkSession
    drawers = placed.groupBy("wing", "room").agg(F.max("path").alias("path")).withColumn("ord", F.lit(0))
    return Catalogue(
        placed.groupBy(F.col("wing").alias("name")).agg(F.max("type").alias("type")).withColumn("keywords", F.array().cast("array<string>")),
        placed.select("wing", "room").distinct(), drawers,
        spark.createDataFrame([], "wing string, room string, hall_type string, content string"),
        spark.createDataFrame([], "id string, wing_a string, wing_b string, room string, hall_a string, hall_b string"))


def touched(notes: DataFrame) -> DataFrame:
    """(wing, room, path) after single writes in order of ord: each write makes its room anew, so its last path stays."""
    return notes.select(T.room_of(T.path_parts("rel_path"), "stem").alias("p"), "rel_path", "ord").where("p is not null").groupBy(
        F.col("p.wing").alias("wing"), F.col("p.room").alias("room")).agg(F.max_by("rel_path", "ord").alias("path"))


def with_rooms(c: Catalogue, made: DataFrame) -> Catalogue:
    """A catalogue after notes were written (made: wing, room, path): their rooms are made anew, each with its note as the only drawer."""
    rooms = made.select("wing", "room").distinct()
    new = made.select(F.col("wing").alias("name"), F.lit("project").alias("type"), F.array().cast("array<string>").alias("keywords")).dropDuplicates(["name"])
    away = lambda df: df.join(rooms, ["wing", "room"], "left_anti")
    return Catalogue(
        c.wings.select("name", "type", "keywords").unionByName(new.join(c.wings.select("name"), "name", "left_anti")), away(c.rooms).select("wing", "room").union(rooms),
        away(c.drawers).select("wing", "room", "path", "ord").union(made.select("wing", "room", "path", F.lit(0).alias("ord"))),
        away(c.halls).select("wing", "room", "hall_type", "content"), c.tunnels)


def between(tunnels: DataFrame, pairs: DataFrame) -> DataFrame:
    """Tunnels between pairs (wing_1, wing_2), in either direction."""
    ends = lambda a, b: F.struct(F.least(a, b).alias("x"), F.greatest(a, b).alias("y"))
    return tunnels.withColumn("_k", ends("wing_a", "wing_b")).join(
        pairs.withColumn("_k", ends("wing_1", "wing_2")), "_k").select("wing_1", "wing_2", *tunnels.columns)


def traverse(c: Catalogue, starts: DataFrame) -> DataFrame:
    """(wing, room, tunnel, other, hall, drawers): the rooms reached from each start (wing, room) over tunnels by room name. A tunnel
    that doesn't touch the start's wing leads to its first wing."""
    met = starts.join(c.tunnels, "room")
    own = F.col("wing_a") == F.col("wing")
    gone = met.select("wing", "room", F.col("id").alias("tunnel"), F.when(own, F.col("wing_b")).otherwise(F.col("wing_a")).alias("other"),
                      F.when(own, F.col("hall_b")).otherwise(F.col("hall_a")).alias("hall"))
    there = c.rooms.select(F.col("wing").alias("other"), "room")
    count = c.drawers.groupBy(F.col("wing").alias("other"), "room").agg(F.count("*").alias("drawers"))
    return gone.join(there, ["other", "room"]).join(count, ["other", "room"], "left").select(
        "wing", "room", "tunnel", "other", "hall", F.coalesce("drawers", F.lit(0)).cast("long").alias("drawers"))


def lookup(c: Catalogue, rooms: DataFrame) -> DataFrame:
    """(wing, room, there, path) for rooms asked for: a row for each drawer, one without a path if there are none."""
    known = c.rooms.withColumn("_there", F.lit(True))
    return rooms.join(known, ["wing", "room"], "left").join(c.drawers.select("wing", "room", "path"), ["wing", "room"], "left").select(
        "wing", "room", F.coalesce("_there", F.lit(False)).alias("there"), "path")


def by_room(tunnels: DataFrame, room: str) -> DataFrame:
    return tunnels.where(F.col("room") == room)


def room_counts(c: Catalogue) -> DataFrame:
    """(wing, room, drawers), rooms without drawers too."""
    n = c.drawers.groupBy("wing", "room").agg(F.count("*").alias("drawers"))
    return c.rooms.join(n, ["wing", "room"], "left").select("wing", "room", F.coalesce("drawers", F.lit(0)).cast("long").alias("drawers"))


def stats(c: Catalogue) -> DataFrame:
    """(wing_count, room_count, drawer_count, tunnel_count), one row."""
    n = lambda df, name: df.agg(F.count("*").alias(name))
    return n(c.wings, "wing_count").join(n(c.rooms, "room_count")).join(n(c.drawers, "drawer_count")).join(n(c.tunnels, "tunnel_count"))
