"""The file catalogue: metadata edits, status, cycle order, checks and working images."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumifield.functions import constants as K
from lumifield.functions.lookup import attach
from lumifield.functions.storage import store

DEFAULTS = {
    "axes": K.AXES, "unit": K.UNIT, "PhysicalSizeX": K.PIXEL_SIZE, "PhysicalSizeY": K.PIXEL_SIZE,
    "max_size": K.MAX_SIZE, "reference_channel": 0, "prefix": K.PREFIX, "overlap": K.OVERLAP,
    "num_tiles": K.NUM_TILES,
}


def with_defaults(files: DataFrame) -> DataFrame:
    """Metadata columns that are absent or NULL take their default, a value per row."""
    return files.withColumns({
        k: F.coalesce(F.col(k), F.lit(v)) if k in files.columns else F.lit(v) for k, v in DEFAULTS.items()})


def apply_metadata(files: DataFrame, edits: DataFrame, key: str = "path") -> DataFrame:
    """New values for the edited files; fields the catalogue does not know are ignored."""
    known = [c for c in edits.columns if c in files.columns and c != key]
    new = edits.select(key, *[F.col(c).alias(f"_new_{c}") for c in known])
    joined = files.join(new, key, "left")
    return joined.select(*[
        F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c) if c in known else F.col(c) for c in files.columns])


def same_metadata(files: DataFrame, fields: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Are the selected files' metadata all equal? Least and greatest record are compared, so no
    distinct values are shuffled. An empty selection is not equal."""
    record = F.struct(*fields)
    return files.groupBy(*by).agg(
        F.min(record).alias("_lo"), F.max(record).alias("_hi"), F.count(F.lit(1)).alias("_n")).select(
        *by, (F.col("_lo").eqNullSafe(F.col("_hi")) & (F.col("_n") > 0)).alias("all_same"))


def status(is_reference: str = "is_reference", working_ndim: str = "working_ndim") -> Column:
    nd = F.col(working_ndim)
    return (
        F.when(F.col(is_reference), K.STATUS_REFERENCE)
        .when(F.coalesce(nd, F.lit(0)) == 0, K.STATUS_RAW)
        .when(nd == 2, K.STATUS_SHADE_CORRECTED)
        .otherwise(K.STATUS_ALIGNED))


def set_reference(files: DataFrame, chosen: DataFrame, by: Sequence[str] = ("slide",), key: str = "path") -> DataFrame:
    """Make one file per group the reference; the one before goes back to the status its working
    image has earned. Other files keep the status they have, if the catalogue holds one."""
    picked = chosen.select(*by, F.col(key).alias("_chosen"))
    out = attach(files, picked, by, how="left", spread_by=(key,))
    is_ref = F.when(F.col("_chosen").isNotNull(), F.col(key) == F.col("_chosen")).otherwise(F.col("is_reference"))
    touched = is_ref | F.col("is_reference")
    now = out.withColumns({"_touched": touched, "is_reference": is_ref})
    kept = F.when(F.col("_touched"), status()).otherwise(F.col("status")) if "status" in files.columns else status()
    return now.withColumn("status", kept).drop("_chosen", "_touched")


def cycle_order(files: DataFrame, by: Sequence[str] = ("slide",), key: str = "path") -> DataFrame:
    """Cycle number inside each selection: the reference first, then by path; each file once."""
    once = files.groupBy(*by, key).agg(F.bool_or("is_reference").alias("is_reference"))
    order = Window.partitionBy(*by).orderBy(F.desc("is_reference"), F.col(key))  # a selection is a few files
    return once.withColumn("cycle", (F.row_number().over(order) - 1).cast("int"))


def fluorescent_channels(files: DataFrame, key: str = "path") -> DataFrame:
    """One row per fluorescent channel with its 0-based position among them (chan_rank)."""
    channels = F.sequence(F.lit(0), F.col("n_channels") - 1)
    fluor = F.filter(channels, lambda c: c != F.col("reference_channel"))
    return files.select(key, F.posexplode(fluor).alias("chan_rank", "channel"))


def check_reference(files: DataFrame) -> DataFrame:
    """Adds ``valid``: is the reference channel one of the file's channels?"""
    return files.withColumn("valid", F.col("reference_channel") < F.col("n_channels"))


def split_valid(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, bad) files; bad ones are reported and left out."""
    checked = check_reference(files)
    return checked.where("valid").drop("valid"), checked.where(~F.col("valid")).drop("valid")


def require_valid(files: DataFrame) -> DataFrame:
    """Strict form: the job stops at the first bad file."""
    stop = F.raise_error(F.concat(F.lit("reference channel out of range: "), F.col("path")))
    ok = F.col("reference_channel") < F.col("n_channels")
    return files.withColumn("reference_channel", F.when(ok, F.col("reference_channel")).otherwise(stop.cast("int")))


def fallback_channel() -> Column:
    """The reference channel, or channel 0 where it is out of range."""
    return F.when(F.col("reference_channel") < F.col("n_channels"), F.col("reference_channel")).otherwise(0)


def sort_files(files: DataFrame, column: str, ascending: bool = True) -> DataFrame:
    return files.orderBy(F.col(column).asc() if ascending else F.col(column).desc())


def with_working_image(px: DataFrame, working: DataFrame, files: DataFrame, image: Sequence[str] = ("file",)) -> DataFrame:
    """Samples with working images in place: a 2-D one replaces the reference channel, a 3-D one the
    whole stack. Which planes to keep follows from the catalogue alone, so pixels are not joined to
    pixels. ``files``: image, reference_channel, working_ndim; any other number of dimensions leaves the
    image as it is. Samples of an image that ``files`` doesn't list stop the job."""
    info = store(files.select(*image, "reference_channel", F.coalesce("working_ndim", F.lit(0)).alias("working_ndim")), "info")  # once for both joins
    is_ref = F.col("channel") == F.col("reference_channel")
    nd = F.col("working_ndim")
    stop = F.raise_error(F.concat(F.lit("no such image in the catalogue: "), F.to_json(F.struct(*image))))
    listed = F.when(nd.isNotNull(), nd).otherwise(stop.cast("int"))
    base = attach(px, info, image, how="left").withColumn("working_ndim", listed).where((nd != 3) & ((nd != 2) | ~is_ref))
    new = attach(working, info, image).where((nd == 3) | ((nd == 2) & is_ref))
    return base.select(*px.columns).unionByName(new.select(*px.columns))


def channel_index(column: str) -> Column:
    """First number in a channel name, minus one; NULL when there is none."""
    return F.regexp_extract(F.col(column), r"(\d+)", 1).try_cast("int") - 1


def with_channel_index(df: DataFrame, column: str, current: str) -> DataFrame:
    """Set ``current`` from the channel name; a name without a number leaves it unchanged."""
    return df.withColumn(current, F.coalesce(channel_index(column), F.col(current)))
