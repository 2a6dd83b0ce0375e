"""Append-only history: runs, letter versions, field corrections, voided letters, projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.fields import as_date, parse_chainage_range
from ..session import grown
from .ordering import previous_in_order


def current(letters: DataFrame) -> DataFrame:
    return letters.where("is_current")


def history(letters: DataFrame) -> DataFrame:
    """Versions of each logical letter in order, with the version before and the one after.

    A logical letter has one version per reprocessing of its document.
    """
    versions = Window.partitionBy("package_id", "serial").orderBy("created_at", "letter_id")
    return letters.withColumns(
        {
            "version": F.row_number().over(versions),
            "previous_id": F.lag("letter_id").over(versions),
            "next_id": F.lead("letter_id").over(versions),
        }
    )


def as_of(letters: DataFrame, moment: Column) -> DataFrame:
    """The version of each logical letter that was live at a moment."""
    seen = letters.where(F.col("created_at") <= moment)
    latest = seen.groupBy("package_id", "serial").agg(
        F.max(F.struct("created_at", "letter_id")).alias("_latest")
    )
    return (
        seen.join(latest, ["package_id", "serial"])
        .where(F.struct("created_at", "letter_id") == F.col("_latest"))
        .drop("_latest")
    )


def as_of_each(letters: DataFrame, asked: DataFrame) -> DataFrame:
    """For many moments at once the version of a logical letter that was live then, null before its first.

    `asked` has package_id, serial and moment; one row per distinct ask, also for unknown letters and missing values. Versions
    and moments are merged in time order per letter and day. A day hands on its last version only, so a letter with very many
    versions or asks is no one group.
    """
    key = ["package_id", "serial"]
    asks = asked.select(*key, "moment").distinct()
    usable = F.col("package_id").isNotNull() & F.col("serial").isNotNull() & F.col("moment").isNotNull()
    found = F.struct("created_at", "letter_id")
    events = (
        letters.where("created_at IS NOT NULL")
        .select(*key, F.col("created_at").alias("moment"), F.lit(0).alias("is_ask"), found.alias("_found"))
        .unionByName(asks.where(usable).withColumn("is_ask", F.lit(1)), allowMissingColumns=True)
        .withColumn("_day", F.to_date("moment"))
        .where("package_id IS NOT NULL AND serial IS NOT NULL AND _day IS NOT NULL")
    )
    # versions of the asked moment itself count
    order = Window.partitionBy(*key, "_day").orderBy("moment", "is_ask")
    merged = events.withColumns(
        {
            "_today": F.max("_found").over(order.rowsBetween(Window.unboundedPreceding, 0)),
            "_ends_day": F.lead("is_ask").over(order).isNull(),
        }
    )
    days = merged.where("_ends_day").select(*key, "_day", F.col("_today").alias("_last"))
    earlier = Window.partitionBy(*key).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    carried = days.select(*key, "_day", F.max("_last").over(earlier).alias("_before"))
    live = (
        merged.where("is_ask = 1")
        .join(grown(carried), [*key, "_day"])
        .select(*key, "moment", F.coalesce("_today", "_before").alias("_live"))
    )
    nothing = asks.where(~usable)
    return live.select(*key, "moment", "_live.letter_id", "_live.created_at").unionByName(nothing, allowMissingColumns=True)


def publish_runs(runs: DataFrame) -> DataFrame:
    """The newest succeeded run of each (document, package) is current; older ones point to it.

    Failed and running ones keep their state. The newest is a maximum per document, taken before
    the shuffle.
    """
    key = ["package_id", "document_id"]
    newest = (
        runs.where("status = 'succeeded'")
        .groupBy(*key)
        .agg(F.max_by("run_id", F.struct("started_at", "run_id")).alias("_newest"))
    )
    ok = F.col("status") == "succeeded"
    is_newest = F.coalesce(ok & (F.col("run_id") == F.col("_newest")), F.lit(False))
    return (
        runs.join(newest, key, "left")
        .withColumns(
            {
                "is_current": is_newest,
                "superseded_by": F.when(ok & ~is_newest, F.col("_newest")),
                "status": F.when(ok & ~is_newest, "superseded").otherwise(F.col("status")),
            }
        )
        .drop("_newest")
    )


def apply_review(fields: DataFrame, actions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Verify, reject or correct fields -> (fields, events).

    `actions`: field_id, action, actor, new_value, note, acted_at, and new_verbatim if the printed text was corrected too;
    without it a correction keeps the printed text. Actions on one field apply in time order until a correction replaces it;
    later ones, and any on a field that is not current, become 'refused' events. Of corrections at one time the first by
    value, printed text, note and actor counts. A correction adds a row, also one to no value, and keeps the old one.
    """
    columns = fields.columns
    if "new_verbatim" not in actions.columns:
        actions = actions.withColumn("new_verbatim", F.lit(None).cast("string"))
    is_correction = F.col("action") == "corrected"
    turn = F.struct("acted_at", "new_value", "new_verbatim", "note", "actor")
    targets = fields.where("is_current").select("field_id", "letter_id", F.col("value").alias("old_value"))
    corrections = actions.where(is_correction).groupBy("field_id").agg(F.min(turn).alias("_fix"))
    judged = (
        actions.join(grown(targets), "field_id", "left")
        .join(grown(corrections), "field_id", "left")
        .withColumn(
            "accepted",
            F.col("letter_id").isNotNull()
            & F.when(is_correction, turn.eqNullSafe(F.col("_fix"))).otherwise(
                F.col("_fix").isNull() | (F.col("acted_at") <= F.col("_fix.acted_at"))
            ),
        )
    )
    new_id = F.concat(F.col("field_id").cast("string"), F.lit("/corrected"))
    events = judged.select(
        "letter_id",
        F.when(F.col("accepted") & is_correction, new_id)
        .otherwise(F.col("field_id").cast("string"))
        .alias("field_id"),
        "actor",
        F.when(F.col("accepted"), F.col("action")).otherwise("refused").alias("action"),
        F.when(F.col("accepted") & is_correction, F.col("old_value")).alias("old_value"),
        F.when(F.col("accepted") & is_correction, F.col("new_value")).alias("new_value"),
        "note",
        "acted_at",
    )
    # whether the field is current is seen where the marks meet the fields, so those move once
    in_time = F.col("_fix").isNull() | (F.col("acted_at") <= F.col("_fix.acted_at"))
    marks = (
        actions.where(~is_correction).join(grown(corrections), "field_id", "left").where(in_time)
        .groupBy("field_id").agg(F.max_by("action", F.struct("acted_at", "action")).alias("_mark"))
    )
    joined = fields.join(grown(marks), "field_id", "left").join(grown(corrections), "field_id", "left")
    live = F.col("is_current") & F.col("letter_id").isNotNull()
    fixed = F.col("is_current") & F.col("_fix").isNotNull()
    # the old row and its correction leave one row of the joined fields, which two branches would move twice
    is_new = F.col("_is_new")
    both, alone = F.array(F.lit(False), F.lit(True)), F.array(F.lit(False))
    marked = F.coalesce(F.when(live, F.col("_mark")), "review_status")
    values = {
        "superseded_by": F.when(fixed & ~is_new, new_id),
        "review_status": F.when(is_new, "corrected").otherwise(marked),
        "is_current": F.col("is_current") & (is_new | ~fixed),
        "field_id": F.when(is_new, new_id).otherwise(F.col("field_id").cast("string")),
        "value": F.when(is_new, F.col("_fix.new_value")).otherwise(F.col("value")),
        "verbatim": F.when(is_new, F.coalesce("_fix.new_verbatim", "verbatim")).otherwise(F.col("verbatim")),
        "page_no": F.when(~is_new, F.col("page_no")),
        "validation": F.when(is_new, "human_corrected").otherwise(F.col("validation")),
    }
    columns = [*columns, "superseded_by"]
    rows = joined.withColumn("_is_new", F.explode(F.when(fixed, both).otherwise(alone)))
    after = rows.withColumns({name: value for name, value in values.items() if name in columns}).select(*columns)
    return after, events


def void(letters: DataFrame, actions: DataFrame) -> DataFrame:
    """Voided letters leave the register; their serial stays taken. `actions`: letter_id, reason."""
    reasons = actions.groupBy("letter_id").agg(F.min("reason").alias("_reason"))
    return (
        letters.join(reasons, "letter_id", "left")
        .withColumns(
            {
                "is_voided": F.col("is_voided") | F.col("_reason").isNotNull(),
                "void_reason": F.col("_reason"),
            }
        )
        .drop("_reason")
    )


def serial_audit(letters: DataFrame) -> DataFrame:
    """Gaps in the serials in use, and serials with more than one current letter, as rows."""
    used = letters.groupBy("package_id", "serial").agg(
        F.count_if("is_current").alias("current_n"), F.max((~F.col("is_voided")).cast("int")).alias("in_use")
    )
    duplicates = used.where("current_n > 1").select(
        "package_id", F.lit("duplicate").alias("finding"), F.col("serial").alias("first_serial"),
        F.col("serial").alias("last_serial"),
    )
    kept = used.where("in_use = 1").withColumn("no_day", F.lit(None).cast("date"))
    before = F.col("_before.serial")
    gaps = (
        previous_in_order(kept, ["package_id"], "no_day", "serial", ["serial"], "_before")
        .where(F.col("serial") - F.coalesce(before, F.lit(0)) > 1)
        .select(
            "package_id", F.lit("gap").alias("finding"),
            (F.coalesce(before, F.lit(0)) + 1).alias("first_serial"),
            (F.col("serial") - 1).alias("last_serial"),
        )
    )
    return gaps.unionByName(duplicates)


# The fields a letter row repeats.
PROJECTED = ["letter_ref", "dated", "received", "from_party", "to_party", "subject"]


def project_letters(fields: DataFrame) -> DataFrame:
    """Letter columns recomputed from the current fields with index 0."""
    firsts = fields.where("is_current AND field_index = 0 AND letter_id IS NOT NULL").where(
        F.col("field_key").isin(PROJECTED)
    )
    wide = firsts.groupBy("package_id", "letter_id").agg(
        *[F.max_by("value", F.when(F.col("field_key") == k, F.col("field_id"))).alias(k) for k in PROJECTED]
    )
    return wide.withColumns({"dated": as_date(F.col("dated")), "received": as_date(F.col("received"))})


def chainages(fields: DataFrame) -> DataFrame:
    """(letter, field, lo, hi) of current chainage fields, metres, both ends included."""
    span = parse_chainage_range(F.col("value"))
    return (
        fields.where("is_current AND field_key = 'chainage' AND letter_id IS NOT NULL")
        .withColumn("span", span)
        .where("span IS NOT NULL")
        .select("package_id", "letter_id", "field_id", "span.lo", "span.hi")
    )


def clauses(fields: DataFrame) -> DataFrame:
    return fields.where("is_current AND field_key = 'clause' AND letter_id IS NOT NULL").select(
        "package_id", "letter_id", "field_id", F.col("value").alias("clause")
    )
