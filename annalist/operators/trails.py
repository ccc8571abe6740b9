"""Reading trails: lookup, assembly, listing, replay, JSON export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist import schemas
from annalist.functions.clock import rfc3339
from annalist.functions.event_types import is_named
from annalist.functions.payload import ERROR, class_of, object_of, parsed
from annalist.session import scratch_folder

TRAIL_COLUMNS = schemas.TRAILS.fieldNames()
EVENT_COLUMNS = schemas.EVENTS.fieldNames()

STEP_BITS = 12

ACCEPTED, REJECTED = "accepted", "invalid 'from' query parameter"
DEFAULT_FROM = 1


def lookup(requests: DataFrame, trails: DataFrame) -> DataFrame:
    """Each requested id with its trail; ``found`` is false for unknown ids."""
    known = trails.select(*TRAIL_COLUMNS, F.lit(True).alias("found"))
    return requests.select("id").distinct().join(known, "id", "left").withColumn(
        "found", F.coalesce(F.col("found"), F.lit(False))
    )


def trail_lengths(trails: DataFrame, events: DataFrame) -> DataFrame:
    """Number of events per trail. Counted, not the highest sequence: they differ after gaps."""
    counts = events.groupBy(F.col("trail_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return trails.select("id").join(counts, "id", "left").select(
        F.col("id").alias("trail_id"), F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("length")
    )


def part_of(sequence: Column, part_events: int) -> Column:
    """Which assembled row an event belongs to, from 0."""
    return F.floor((F.greatest(sequence, F.lit(1)) - 1) / part_events).cast("bigint")


def with_events(trails: DataFrame, events: DataFrame) -> DataFrame:
    """Each trail beside each of its events: id, name, created_at, updated_at, event.

    A trail without events is one row with a NULL event; events of unknown trails are
    left out. One row per event, whatever a trail's length.
    """
    each = events.select(F.col("trail_id").alias("id"), F.struct(*EVENT_COLUMNS).alias("event"))
    return trails.select(*TRAIL_COLUMNS).join(each, "id", "left")


def list_trails(trails: DataFrame, events: DataFrame) -> DataFrame:
    """:func:`with_events`, newest trail first, ties by id, events in sequence."""
    return with_events(trails, events).orderBy(F.desc("created_at"), "id", "event.sequence", "event.id")


def nested(trails: DataFrame, events: DataFrame, part_events: int) -> DataFrame:
    """Trails with their events nested in sequence order, one row per trail and part.

    For callers that know how many events a row may hold; :func:`with_events` and the
    export need no such bound.

    A trail without events keeps one row with an empty list; events of unknown
    trails are left out. Trail rows and events meet in a single shuffle on
    (trail, part): each trail row is first repeated for the parts its events can
    fall in, which its highest sequence tells. Sequences are unique per trail, so
    a part holds at most ``part_events`` events.
    """
    highest = events.groupBy(F.col("trail_id").alias("id")).agg(F.max("sequence").alias("top"))
    zero = F.lit(0).cast("bigint")
    last_part = F.coalesce(part_of(F.col("top"), part_events), zero)
    heads = (
        trails.select(*TRAIL_COLUMNS)
        .join(highest, "id", "left")
        .select(
            "id",
            F.col("top").isNull().alias("childless"),
            F.struct(*TRAIL_COLUMNS[1:]).alias("head"),
            last_part.alias("last_part"),
        )
        # In two steps, so that no row ever holds a list of all parts of a huge trail.
        .withColumn("step", F.explode(F.sequence(zero, F.shiftright("last_part", STEP_BITS))))
        .withColumn(
            "part",
            F.explode(
                F.sequence(
                    F.shiftleft("step", STEP_BITS),
                    F.least("last_part", F.shiftleft(F.col("step") + 1, STEP_BITS) - 1),
                )
            ),
        )
        .drop("last_part", "step")
    )
    # Sequence leads the struct because it is what the list is sorted by.
    child = F.struct("sequence", *[c for c in EVENT_COLUMNS if c != "sequence"])
    children = events.select(
        F.col("trail_id").alias("id"), part_of(F.col("sequence"), part_events).alias("part"), child.alias("event")
    )
    return (
        heads.unionByName(children, allowMissingColumns=True)
        .groupBy("id", "part")
        .agg(
            F.max("head").alias("head"),
            F.max("childless").alias("childless"),
            F.sort_array(F.collect_list("event")).alias("events"),
        )
        # A gap in the sequences may leave a part without events.
        .where(F.col("head").isNotNull() & (F.col("childless") | (F.size("events") > 0)))
        .select("id", "head.*", "part", "events")
    )


def parse_replay_args(requests: DataFrame) -> DataFrame:
    """Read the start of each replay request (trail_id, from_text).

    Absent or empty means 1. Anything that is not a base-10 64-bit integer is
    rejected; neither blanks nor a line end may stand around the digits.
    """
    given = F.col("from_text")
    absent = given.isNull() | (given == "")
    parsed = F.when(given.rlike(r"\A[+-]?[0-9]+\z"), given.try_cast("bigint"))
    start = F.when(absent, F.lit(DEFAULT_FROM).cast("bigint")).otherwise(parsed)
    return requests.select(
        "trail_id",
        "from_text",
        start.alias("from_sequence"),
        F.when(start.isNull(), REJECTED).otherwise(ACCEPTED).alias("status"),
    )


def requested_events(events: DataFrame, requests: DataFrame) -> DataFrame:
    return (
        events.join(requests.select("trail_id", "from_sequence"), "trail_id")
        .where(F.col("sequence") >= F.col("from_sequence"))
        .select(*EVENT_COLUMNS)
    )


def replay(events: DataFrame, requests: DataFrame) -> DataFrame:
    """Events from the requested sequence on, inclusive, in stored order.

    ``requests``: trail_id, from_sequence, at most one row per trail. A trail with
    very many events is split by adaptive skew handling, which can act here because
    the sort after the join shuffles anyway.
    """
    return requested_events(events, requests).orderBy("trail_id", "sequence")


KEEP_NULLS = {"ignoreNullFields": "false"}
# The sections of a document, in order.
HEAD, BODY, TAIL = 0, 1, 2
UNREADABLE = "unreadable payload"


def _event_json(value: Column) -> Column:
    """An event as JSON. The exported key names, in order."""
    fields = F.struct(
        F.col("id").alias("ID"),
        F.col("trail_id").alias("TrailID"),
        F.col("type").alias("Type"),
        value.alias("Payload"),
        rfc3339(F.col("occured_at")).alias("OccuredAt"),
        F.col("sequence").alias("Sequence"),
    )
    return F.to_json(fields, KEEP_NULLS)


def _written_events(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each event as JSON (trail_id, sequence, event_id, json; NULL for an unreadable payload),
    and per trail its first place and whether any event of it is unreadable.

    The events are worked out and their payloads parsed once, into a table in the scratch
    folder that all fragments are made of.
    """
    spark, path = events.sparkSession, scratch_folder(events.sparkSession, "exported")
    read = events.withColumn("value", parsed(F.col("payload")))
    readable = class_of(F.col("value"), F.col("payload")) != ERROR
    rows = read.select(
        "trail_id",
        "sequence",
        F.col("id").alias("event_id"),
        F.when(readable, _event_json(object_of(F.col("value")))).alias("json"),
    )
    rows.write.parquet(path)
    written = spark.read.schema(rows.schema).parquet(path)
    edges = written.groupBy("trail_id").agg(
        F.min(F.struct("sequence", "event_id")).alias("first"), F.bool_or(F.col("json").isNull()).alias("bad")
    )
    return written, edges


def _body(written: DataFrame, edges: DataFrame) -> DataFrame:
    """id, section, sequence, event_id, json: each event, with a comma before all but a trail's first."""
    comma = F.when(F.struct("sequence", "event_id") == F.col("first"), F.lit("")).otherwise(F.lit(","))
    return written.join(edges, "trail_id").select(
        F.col("trail_id").alias("id"), F.lit(BODY).alias("section"), "sequence", "event_id", F.concat(comma, "json").alias("json")
    )


def _edges(rows: DataFrame, key: str, *sections: tuple[int, Column]) -> DataFrame:
    """The fragments of documents that are no events; those without text are left out."""
    parts = F.array(*[F.struct(F.lit(section).alias("section"), json.alias("json")) for section, json in sections])
    nothing = F.lit(None)
    return rows.select(F.col(key).alias("id"), F.explode(parts).alias("part")).where(F.col("part.json").isNotNull()).select(
        "id",
        "part.section",
        nothing.cast("bigint").alias("sequence"),
        nothing.cast("string").alias("event_id"),
        "part.json",
    )


def export_trails(trails: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The JSON document of each trail in fragments, and the trails that cannot be exported.

    Fragments are rows (id, section, sequence, event_id, json): a head, one per event, a
    tail. A trail's rows in the order of these columns, joined, are its document, however
    long it is. Payloads are embedded as JSON objects. A trail with an unreadable
    payload has no document and is refused (id, reason).
    """
    written, edges = _written_events(events)
    judged = trails.join(edges.withColumnRenamed("trail_id", "id"), "id", "left")
    good = judged.where(~F.coalesce("bad", F.lit(False)))
    opening = F.to_json(F.struct(F.col("id").alias("ID"), F.col("name").alias("Name")), KEEP_NULLS)
    head = F.concat(F.substring(opening, F.lit(1), F.length(opening) - 1), F.lit(',"Events":['))
    times = F.struct(rfc3339(F.col("created_at")).alias("CreatedAt"), rfc3339(F.col("updated_at")).alias("UpdatedAt"))
    closing = F.to_json(times, KEEP_NULLS)
    tail = F.concat(F.lit("],"), F.substring(closing, F.lit(2), F.length(closing)))
    theirs = good.where(F.col("first").isNotNull()).select(F.col("id").alias("trail_id"), "first")
    fragments = _edges(good, "id", (HEAD, head), (TAIL, tail)).unionByName(_body(written, theirs))
    return fragments, judged.where("bad").select("id", F.lit(UNREADABLE).alias("reason"))


def export_replay(events: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each replay as a JSON list in fragments, like :func:`export_trails`, and the refused ones.

    A replay without events is ``null``, unlike a trail without events.
    """
    written, edges = _written_events(requested_events(events, requests))
    good = requests.select("trail_id").join(edges, "trail_id", "left").where(~F.coalesce("bad", F.lit(False)))
    some = F.col("first").isNotNull()
    head, tail = F.when(some, F.lit("[")).otherwise(F.lit("null")), F.when(some, F.lit("]"))
    fragments = _edges(good, "trail_id", (HEAD, head), (TAIL, tail)).unionByName(_body(written, edges.where(~F.col("bad"))))
    return fragments, edges.where("bad").select(F.col("trail_id").alias("id"), F.lit(UNREADABLE).alias("reason"))


def write_documents(fragments: DataFrame, folder: str) -> None:
    """Write documents as text, fragment by fragment and one after the other.

    Each fragment is a line, as JSON may be broken there. Fragments are dealt out by
    ranges of (id, section, sequence), so a long document may go on in the next file.
    """
    order = ["id", "section", "sequence", "event_id"]
    fragments.repartitionByRange(*order).sortWithinPartitions(*order).select("json").write.text(folder)


def event_type_counts(events: DataFrame) -> DataFrame:
    """Events per type; ``named`` marks the four named types of the open type column."""
    return events.groupBy("type").agg(F.count(F.lit(1)).alias("events")).withColumn("named", is_named(F.col("type")))
