"""Versioned upsert with change detection and edit history.

A batch of arrivals is merged into the current articles as one set operation.
Only narrow rows (key, order, hash) are windowed; bodies are fetched afterwards,
for the few versions that need them, by an equi-join on a unique key.

Skew.  One url may hold a large part of all arrivals, with any order values.  Its
sequence is cut by position, where the slices of a range sort by (url, seq) end
(``operators/scan``), and the running state is computed as a two-level scan:

1. inside each (slice, url): previous hash and running number of changes;
2. over one summary row per (slice, url): whether the slice's first row is a
   change, and how many versions came before it;
3. both are joined on (slice, url).

Arrivals with one (url, seq) are folded before they move, so slices are even: no
window of level 1 exceeds a slice, none of level 2 the number of slices.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions import text as tx
from newsloom.operators import scan
from newsloom.sources.tables import kept

STORED_SEQ = -(1 << 62)  # the stored version precedes every arrival

NEW, UPDATED, SAME = "nueva", "actualizada", "sin_cambios"


@dataclass
class Upsert:
    """Results of one merge; all start from ``resolved``, which is written once."""

    resolved: DataFrame  # narrow: one row per stored or arriving version
    status: DataFrame    # url, seq, estado of every arrival
    history: DataFrame   # superseded versions
    delta: DataFrame     # new state of new and changed urls
    current: DataFrame   # full new state


def article_key(url: Column) -> Column:
    """Stable surrogate key of a new article; needs no global counter."""
    return F.xxhash64(url)


def ordered(existing: DataFrame, incoming: DataFrame, track_title: bool = False,
            slices: int | None = None) -> DataFrame:
    """Narrow rows of stored and arriving versions, one per (url, seq), in slices.

    Stored rows whose url does not arrive are left out.  Of several arrivals with one
    order, or one delivered twice, the least by hash and content counts.
    """
    def fingerprint(body_hash: Column) -> Column:
        if not track_title:
            return body_hash
        return F.md5(F.concat(F.col("titulo"), F.lit("\u0000"), body_hash))

    arrivals = incoming.select(
        "url", F.col("seq").cast("long").alias("seq"),
        F.md5("texto").alias("hash"), row_tie().alias("tie"), fingerprint(F.md5("texto")).alias("h"),
        F.struct(article_key(F.col("url")).alias("id"), "fuente", "fecha_pub").alias("own"),
    )
    stored = existing.join(incoming.select("url").distinct(), "url", "left_semi").select(
        "url", F.lit(STORED_SEQ).cast("long").alias("seq"),
        F.col("hash_texto").alias("hash"), F.lit(0).cast("long").alias("tie"),
        fingerprint(F.col("hash_texto")).alias("h"),
        F.struct("id", "fuente", "fecha_pub").alias("own"),
    )
    version = F.struct("hash", "tie", "h", "own")
    folded = stored.unionByName(arrivals).groupBy("url", "seq").agg(
        F.min_by(version, F.struct("hash", "tie")).alias("v")
    ).select("url", "seq", "v.*")
    return scan.sliced(folded, ["url", "seq"], slices)


def resolve(existing: DataFrame, incoming: DataFrame, track_title: bool = False,
            slices: int | None = None) -> DataFrame:
    """Version number, total versions and outcome of every arrival.

    A change is a body hash different from the one before it for the same url
    (``track_title`` adds the title to the comparison).
    """
    inside = scan.inside("url", "seq")
    so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # Bodies are scanned and hashed once; both levels read the written rows.
    rows = (
        kept(ordered(existing, incoming, track_title, slices), "versions")
        .withColumn("prev", F.lag("h").over(inside))
        .withColumn("last", F.lead("seq").over(inside).isNull())
        .withColumn("first_h", F.first("h").over(so_far))
        .withColumn("edit", F.col("prev").isNotNull() & (F.col("h") != F.col("prev")))
        .withColumn("edits", F.sum(F.col("edit").cast("long")).over(so_far))
        .withColumn("origin", F.first("own").over(so_far))
    )

    across = scan.across("url")
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    whole = across.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    bounds = (
        rows.filter("last")
        .withColumn("prev_h", F.lag("h").over(across))
        .withColumn("opens", F.col("prev_h").isNull() | (F.col("prev_h") != F.col("first_h")))
        .withColumn("steps", F.col("edits") + F.col("opens").cast("long"))
        .select(
            "url", "slice", "opens",
            F.coalesce(F.sum("steps").over(before), F.lit(0).cast("long")).alias("base"),
            F.sum("steps").over(whole).alias("versions"),
            F.first("origin").over(across).alias("url_origin"),
        )
    )
    # Never NULL; naming ``own`` keeps the columns of both readers equal, which
    # is what lets the exchange be reused.
    origin = F.coalesce("url_origin", "own")

    changed = F.when(F.col("prev").isNull(), F.col("opens")).otherwise(F.col("edit"))
    version = F.col("base") + F.col("opens").cast("long") + F.col("edits")
    return (
        rows.select("url", "slice", "seq", "hash", "tie", "prev", "edit", "edits", "own")
        .join(bounds, ["url", "slice"])
        .select(
            "url", "seq", "hash", "tie",
            (F.col("seq") == STORED_SEQ).alias("stored"),
            changed.alias("changed"),
            version.alias("version"),
            "versions",
            F.when(~changed, SAME).when(version == 1, NEW).otherwise(UPDATED).alias("estado"),
            origin["id"].alias("id"), origin["fuente"].alias("fuente"),
            origin["fecha_pub"].alias("fecha_pub"),
        )
    )


def row_tie() -> Column:
    """Tells arrivals with the same url and order apart."""
    return F.xxhash64("texto", "titulo", "fuente", "fecha_pub")


BITS = 1 << 27  # of a sieve: 16 MB, however many keys it takes
_CELL = 1 << 15  # bits of one row of it


def sifted(rows: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are in ``wanted``, and a few more that share a hash with one.

    The hashes of the wanted keys are marked in a table of bounded size that goes to
    every task, so the join that follows moves the bodies it needs and few others.
    """
    at = F.pmod(F.xxhash64(*keys), F.lit(BITS))
    cell, bit = F.floor(at / _CELL).cast("int"), (at % _CELL).cast("int")
    marks = wanted.select(cell.alias("_cell"), bit.cast("long").alias("_bit")).groupBy("_cell").agg(
        F.bitmap_construct_agg("_bit").alias("_marks"))
    byte = F.conv(F.hex(F.substring("_marks", F.floor(F.col("_bit") / 8).cast("int") + 1, F.lit(1))), 16, 10)
    return rows.withColumn("_cell", cell).withColumn("_bit", bit).join(F.broadcast(marks), "_cell").filter(
        F.getbit(byte.cast("int"), F.col("_bit") % 8) == 1).drop("_cell", "_bit", "_marks")


def with_payload(resolved: DataFrame, incoming: DataFrame) -> DataFrame:
    """Title and body of resolved arrivals; repeated rows meet in one partition and fold."""
    keys = ["url", "seq", "tie"]
    payload = incoming.select(
        "url", F.col("seq").cast("long").alias("seq"), row_tie().alias("tie"), "titulo", "texto")
    return resolved.join(sifted(payload, resolved, keys), keys).dropDuplicates(keys)


def status_of(resolved: DataFrame) -> DataFrame:
    return resolved.filter(~F.col("stored")).select("url", "seq", "estado")


def history_of(resolved: DataFrame, existing: DataFrame, incoming: DataFrame,
               now: Column) -> DataFrame:
    """Every superseded version, with the title and body it was stored with."""
    superseded = resolved.filter(F.col("changed") & (F.col("version") < F.col("versions")))
    stored = superseded.filter("stored")
    from_store = stored.join(
        sifted(existing.select("url", "titulo", "texto"), stored, ["url"]), "url")
    from_batch = with_payload(superseded.filter(~F.col("stored")), incoming)
    columns = [
        F.xxhash64("url", "hash", now, "version").alias("id"),
        F.col("id").alias("noticia_id"), "url", "titulo",
        F.col("texto").alias("texto_anterior"), F.col("hash").alias("hash_anterior"),
        now.alias("fecha_cambio"), "version",
    ]
    return from_store.select(*columns).unionByName(from_batch.select(*columns))


def latest_of(resolved: DataFrame) -> DataFrame:
    """Narrow rows of the latest version of each new or changed url."""
    return resolved.filter(
        ~F.col("stored") & F.col("changed") & (F.col("version") == F.col("versions"))
    )


def delta_of(resolved: DataFrame, incoming: DataFrame, now: Column) -> DataFrame:
    """Latest version of each new or changed url, with its title and body.

    Source and published date stay those of the first version.
    """
    latest = latest_of(resolved)
    return with_payload(latest, incoming).select(
        "id", "url", "titulo", "texto", "fuente", F.col("hash").alias("hash_texto"),
        "fecha_pub", now.alias("fecha_scrape"),
    )


def current_of(existing: DataFrame, resolved: DataFrame, delta: DataFrame) -> DataFrame:
    """Stored articles replaced or extended by the delta.

    Replaced urls come from the narrow rows, not from the delta with its bodies.
    """
    replaced = latest_of(resolved).select("url")
    kept = existing.join(replaced, "url", "left_anti").select(*delta.columns)
    return kept.unionByName(delta)


def upsert(existing: DataFrame, incoming: DataFrame, now: str, track_title: bool = False,
           slices: int | None = None) -> Upsert:
    """Merge ``incoming`` into ``existing`` (unique by url).

    Of several arrivals with one url and seq, the first by hash and content counts.
    """
    stamp = F.lit(now).cast("timestamp_ntz")
    resolved = kept(resolve(existing, incoming, track_title, slices), "resolved")
    delta = delta_of(resolved, incoming, stamp)
    return Upsert(
        resolved=resolved,
        status=status_of(resolved),
        history=history_of(resolved, existing, incoming, stamp),
        delta=delta,
        current=current_of(existing, resolved, delta),
    )


def history_for(history: DataFrame, articles: DataFrame, url: str | None = None) -> DataFrame:
    """Edit history of one url (or of all), newest change first."""
    owners = articles.select(F.col("id").alias("articulo"), F.col("url").alias("articulo_url"))
    if url is not None:
        owners = owners.filter(F.col("articulo_url") == url)
    joined = history.join(owners, F.col("noticia_id") == F.col("articulo")).drop("articulo")
    return joined.orderBy("articulo_url", F.desc("fecha_cambio"), F.desc("version"))


def history_direct(history: DataFrame, url: str) -> DataFrame:
    """Edit history read by url alone, without the join."""
    return history.filter(F.col("url") == url).orderBy(
        F.desc("fecha_cambio"), F.desc("version")
    )


def history_cards(history: DataFrame) -> DataFrame:
    """Display columns of a history listing."""
    return history.withColumn("texto_corto", tx.excerpt(F.col("texto_anterior"), 500)).withColumn(
        "guardado", F.date_format("fecha_cambio", "yyyy-MM-dd HH:mm:ss")
    )
