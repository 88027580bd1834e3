"""Catalogues: positional joins, components, event and source summaries, cross-matches, names and lists."""

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sky import flat_separation, lm_from_xy, radec_from_lm, separation, sexagesimal, source_name
from .graph import connected_components, settled


def _with_cell(df: DataFrame, ra: str, dec: str, edge: float) -> DataFrame:
    """Cells of the unit sphere, which need no care at the poles or at right ascension 0."""
    a, d = F.radians(ra), F.radians(dec)
    at = {"cx": F.cos(d) * F.cos(a), "cy": F.cos(d) * F.sin(a), "cz": F.sin(d)}
    return df.withColumns({k: F.floor(v / edge).cast("long") for k, v in at.items()})


def near_pairs(left: DataFrame, right: DataFrame, arcsec: float, lon: tuple[str, str] = ("ra", "dec"), lid: str = "id", rid: str = "id") -> DataFrame:
    """(a, b, sep) of positions within arcsec: an equi-join on cells, then the exact distance.

    The right side, the smaller one, stands in its cell and the 26 around it, so the left is neither
    multiplied nor moved more than once.
    """
    edge = 2 * math.sin(math.radians(arcsec / 3600) / 2) * (1 + 1e-9) + 1e-15
    a = _with_cell(left.select(F.col(lid).alias("a"), F.col(lon[0]).alias("ra_a"), F.col(lon[1]).alias("dec_a")), "ra_a", "dec_a", edge)
    b = _with_cell(right.select(F.col(rid).alias("b"), F.col(lon[0]).alias("ra_b"), F.col(lon[1]).alias("dec_b")), "ra_b", "dec_b", edge)
    step = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(k).alias("k")) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)))
    b = b.withColumn("s", F.explode(step)).withColumns({"cx": F.col("cx") + F.col("s.i"), "cy": F.col("cy") + F.col("s.j"), "cz": F.col("cz") + F.col("s.k")}).drop("s")
    sep = separation(F.col("ra_a"), F.col("dec_a"), F.col("ra_b"), F.col("dec_b"))
    return a.join(b, ["cx", "cy", "cz"]).select("a", "b", sep.alias("sep")).where(F.col("sep") <= arcsec)


FEW_PAIRS = 1 << 20  # near pairs of places that one task may hold, 16 MB


def sky_components(df: DataFrame, arcsec: float, by: str | None = None) -> DataFrame:
    """Adds `component` to rows (id, ra, dec): connected positions, apart for each value of `by`.

    Equal positions are one node, so a hot source meets itself once.
    """
    key = [by] if by else []
    df = settled(df)
    spots = settled(df.groupBy(*key, "ra", "dec").agg(F.min("id").alias("spot")))
    pairs = _keyed_pairs(spots, by, arcsec) if by else near_pairs(spots, spots, arcsec, lid="spot", rid="spot")
    found = connected_components(pairs, few=FEW_PAIRS)
    named = spots.join(found, spots.spot == found.node, "left").select(*key, "ra", "dec", F.coalesce("component", "spot").alias("component"))
    return df.join(named, [*key, "ra", "dec"])


def _keyed_pairs(spots: DataFrame, by: str, arcsec: float) -> DataFrame:
    """Near pairs of one key: distinct positions are paired once, then matched to the keys that hold both."""
    places = spots.groupBy("ra", "dec").agg(F.min("spot").alias("place"))
    near = near_pairs(places, places, arcsec, lid="place", rid="place").select("a", "b")
    at = spots.join(places, ["ra", "dec"]).select(by, "spot", "place")
    one = at.select(F.col(by).alias("key"), F.col("spot").alias("sa"), F.col("place").alias("a"))
    two = at.select(F.col(by).alias("key"), F.col("spot").alias("sb"), F.col("place").alias("b"))
    return one.join(near, "a").join(two, ["key", "b"]).select(F.col("sa").alias("a"), F.col("sb").alias("b"))


PLACE = ["ra", "dec"]


def _nearest_of_places(places: DataFrame, catalogue: DataFrame, arcsec: float) -> DataFrame:
    """(place, src_name, sep) of distinct places (place, ra, dec) with a catalogue row within arcsec: the nearest, by name on a tie."""
    got = near_pairs(places, catalogue.withColumnRenamed("src_name", "name"), arcsec, lid="place", rid="name")
    best = got.groupBy("a").agg(F.min(F.struct(F.round("sep", 9).alias("sep"), F.col("b").alias("name"))).alias("m"))
    return best.select(F.col("a").alias("place"), F.col("m.name").alias("src_name"), F.col("m.sep").alias("sep"))


def _places(df: DataFrame) -> DataFrame:
    """Distinct positions: a source seen a thousand times is matched once."""
    return df.select(*PLACE).distinct().withColumn("place", F.struct(*PLACE))


def nearest(df: DataFrame, catalogue: DataFrame, arcsec: float) -> DataFrame:
    """(id, src_name, sep) of the nearest catalogue row within arcsec, by name on a tie; NULLs if none."""
    places = _places(df)
    found = places.join(_nearest_of_places(places, catalogue, arcsec), "place", "left").drop("place")
    return df.select("id", *PLACE).join(found, PLACE, "left").select("id", "src_name", "sep")


def crossmatch(df: DataFrame, catalogues: list[tuple[str, DataFrame]], arcsec: float) -> DataFrame:
    """The first catalogue with a match names the source; else 'unknown'.  Catalogues are matched with distinct places; rows are joined once."""
    places = _places(df)
    found = places
    for k, (_, cat) in enumerate(catalogues):
        own = _nearest_of_places(places, cat, arcsec).select("place", F.col("src_name").alias(f"n{k}"), F.col("sep").alias(f"s{k}"))
        found = found.join(own, "place", "left")
    hit = lambda pick, last: F.coalesce(*(F.when(F.col(f"n{k}").isNotNull(), pick(k)) for k in range(len(catalogues))), last)
    named = found.select(
        *PLACE, hit(lambda k: F.col(f"n{k}"), F.lit("unknown")).alias("source_name"), hit(lambda k: F.col(f"s{k}"), F.lit(None).cast("double")).alias("source_offset_arcsec"), hit(lambda k: F.lit(catalogues[k][0]), F.lit("")).alias("source_catalog")
    )
    unplaced = {"source_name": "unknown", "source_catalog": ""}
    return df.select("id", *PLACE).join(named, PLACE, "left").select("id", "source_name", "source_offset_arcsec", "source_catalog").fillna(unplaced)


def nearest_time(df: DataFrame, axis: DataFrame, ranges: int = 4096) -> DataFrame:
    """(id, time): the axis time nearest to each row's, the earlier on a tie.

    Distinct times and axis times of one range of time meet in one sorted window, an as-of join both ways; what
    a range lacks comes from the ranges before and behind, a table of `ranges` rows at most.
    """
    wanted = df.select(F.col("time").cast("double").alias("at")).where("time is not null").distinct()
    marks = axis.select(F.col("time").cast("double").alias("mark")).where("mark is not null").distinct()
    ends = marks.agg(F.min("mark").alias("lo"), F.max("mark").alias("hi")).first()  # one row
    if ends.lo is None:
        return df.select("id", F.lit(None).cast("double").alias("time"))
    size = max((ends.hi - ends.lo) / ranges, 1e-300)
    slot = lambda c: F.greatest(F.lit(0), F.least(F.lit(ranges - 1), F.floor((F.col(c) - F.lit(ends.lo)) / F.lit(size)))).cast("int").alias("slot")
    both = wanted.select(slot("at"), "at", F.lit(None).cast("double").alias("mark")).unionAll(marks.select(slot("mark"), F.col("mark"), F.col("mark")))
    has = marks.select(slot("mark"), "mark").groupBy("slot").agg(F.min("mark").alias("first"), F.max("mark").alias("last"))
    slots = df.sparkSession.range(ranges).select(F.col("id").cast("int").alias("slot")).join(has, "slot", "left")
    order = Window.orderBy("slot")  # of at most `ranges` rows
    edges = slots.select("slot", F.last("last", True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("below"), F.first("first", True).over(order.rowsBetween(1, Window.unboundedFollowing)).alias("above"))
    own, upto = Window.partitionBy("slot"), (Window.unboundedPreceding, 0)
    back = F.last("mark", True).over(own.orderBy("at", F.col("mark").asc_nulls_last()).rowsBetween(*upto))
    ahead = F.last("mark", True).over(own.orderBy(F.desc("at"), F.col("mark").asc_nulls_last()).rowsBetween(*upto))
    near = both.withColumns({"back": back, "ahead": ahead}).where("mark is null").join(F.broadcast(edges), "slot")
    near = near.select("at", F.coalesce("back", "below").alias("back"), F.coalesce("ahead", "above").alias("ahead"))
    found = near.select("at", F.when(F.col("back").isNull() | (F.col("ahead") - F.col("at") < F.col("at") - F.col("back")), F.col("ahead")).otherwise(F.col("back")).alias("near"))
    return df.select("id", F.col("time").cast("double").alias("at")).join(found, "at", "left").select("id", F.col("near").alias("time"))


def joined_set(c: Column | str) -> Column:
    """Distinct non-empty values, sorted, joined by commas."""
    return F.array_join(F.array_sort(F.collect_set(F.nullif(F.col(c) if isinstance(c, str) else c, F.lit("")))), ",")


def events(det: DataFrame) -> DataFrame:
    """One row a (grp, component) of detections (id, time, ra, dec, beam, scan, snr, width): the best represents it, lists go by falling S/N."""
    best = F.struct("snr", -F.col("id"))
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("snr")).alias("o"), "id", "beam", "snr", "width")))
    num = F.array_sort(F.collect_set("width"))
    top = lambda c: F.max_by(c, best)
    got = det.groupBy("grp", "component").agg(
        top("time").alias("time"), top("ra").alias("ra"), top("dec").alias("dec"), F.max("snr").alias("max_snr"), top("beam").alias("max_snr_beam"), top("width").alias("max_snr_width"),
        joined_set("beam").alias("beam_ids"), joined_set("scan").alias("scan_ids"), F.array_join(F.transform(num, lambda x: x.cast("string")), ",").alias("width_samples"),
        F.count_distinct(F.nullif("beam", F.lit(""))).alias("n_beams"), F.count(F.lit(1)).alias("n_detections"), ranked.alias("r"),
    )
    return got.select(*[c for c in got.columns if c != "r"], F.array_join("r.beam", ",").alias("beam_all"), F.col("r.snr").alias("snr_all"))


def number(df: DataFrame, name: str, *order) -> DataFrame:
    """Ids from 0 in the given order: ranges of the order are sorted apart and numbered on from the ranges before."""
    part, at = "__part", "__at"
    rows = df.repartitionByRange(*(F.col(c).asc() if isinstance(c, str) else c for c in order)).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id()  # the partition in the upper bits, the place in it in the lower 33
    rows = settled(rows.withColumns({part: F.shiftright(place, 33), at: place.bitwiseAND(F.lit((1 << 33) - 1))}))
    first, n = [], 0
    for r in sorted(rows.groupBy(part).count().collect()):  # a row a partition
        first.append((r[0], n))
        n += r["count"]
    offsets = df.sparkSession.createDataFrame(first, f"{part} long, {name} long")
    return rows.join(F.broadcast(offsets), part).withColumn(name, F.col(name) + F.col(at)).drop(part, at)


def union_of_lists(c: str) -> Column:
    """Set union of comma lists, sorted."""
    return F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(split_strings(F.col(c)))))), ",")


def union_of_numbers(c: str) -> Column:
    ints = F.array_sort(F.array_distinct(F.flatten(F.collect_list(split_ints(F.col(c))))))
    return F.array_join(F.transform(ints, lambda x: x.cast("string")), ",")


def sources(ev: DataFrame) -> DataFrame:
    """Events of one component through all time: (component, ...), the best event represents it."""
    best = F.struct("max_snr", -F.col("event_id"))
    top = lambda c: F.max_by(c, best)
    return ev.groupBy("component").agg(
        top("ra").alias("ra"), top("dec").alias("dec"), F.count(F.lit(1)).alias("n_events"), F.sum("n_detections").alias("n_detections_total"), union_of_lists("beam_ids").alias("beams_all"), union_of_lists("scan_ids").alias("scans_all"),
        F.max("max_snr").alias("max_snr"), top("time").alias("max_snr_time_center"), top("beam_ids").alias("max_snr_event_beams"), top("max_snr_beam").alias("max_snr_beam"), top("max_snr_width").alias("max_snr_width"), union_of_numbers("width_samples").alias("width_samples_all"),
    )


def observations(supers: DataFrame) -> DataFrame:
    """Sources of all scans by component: (component, n_scans, unions, best row)."""
    best = F.struct("max_snr", F.col("scan"), -F.col("id"))
    top = lambda c: F.max_by(c, best)
    return supers.groupBy("component").agg(
        top("ra").alias("ra"), top("dec").alias("dec"), F.max("max_snr").alias("max_snr"), top("scan").alias("max_snr_scan_id"), F.count_distinct("scan").alias("n_scans"), joined_set("scan").alias("scan_ids"),
        union_of_lists("beams_all").alias("beams_all"), top("max_snr_width").alias("max_snr_width"), union_of_numbers("width_samples_all").alias("width_samples_all"),
    )


def split_strings(c: Column) -> Column:
    """A comma list: trimmed, without quotes and blanks."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.regexp_replace(x, r"^[\s'\"]+|[\s'\"]+$", "")), lambda x: x != "")


def split_ints(c: Column) -> Column:
    return F.filter(F.transform(split_strings(c), lambda x: x.try_cast("bigint")), lambda x: x.isNotNull())


def parse_name(name: Column) -> dict[str, Column]:
    """What a candidate file's name says: field, sbid, beam, scan_id, kind, and whether it is consolidated or a summary."""
    get = lambda rx: F.regexp_extract(name, rx, 1)
    # The patterns of candidate file names.
    ends = r"(?i)_(boxcar|variance|periodicity)_%s\.(?:vot|xml|csv)$"
    scan, combined, whole, summed = get(r"(\d{14})"), get(r"(\w+_combined)"), get(ends % "all"), get(ends % "super_summary")
    return {
        "field": get(r"^([^.]+)\."), "sbid": get(r"(SB\d{5,})"), "beam": get(r"(beam\d+)"), "scan_id": F.when(scan != "", scan).otherwise(combined),
        "kind": F.lower(F.when(summed != "", summed).otherwise(whole)), "is_all": (summed == "") & (whole != ""), "is_super": summed != "",
    }


def require_name(files: DataFrame, *parts: str, name: str = "file") -> DataFrame:
    """Rows whose file name has all these parts of parse_name."""
    found = parse_name(F.col(name))
    for p in parts:
        files = files.where(F.coalesce(found[p], F.lit("")) != "")
    return files


def region_line(ra: Column, dec: Column, label: Column, radius: float = 20.0) -> Column:
    """A DS9 circle; braces in labels become parentheses."""
    return F.format_string('fk5; circle(%.6f,%.6f,%.1f") # text={%s}', ra, dec, F.lit(radius), F.translate(label, "{}", "()"))


def region_label(srcname: Column, snr: Column, match: Column) -> Column:
    """Name, S/N and match in one label; a match that is unknown reads ??."""
    part = F.nullif(F.trim(match), F.lit(""))
    text = F.concat_ws(" ", F.nullif(srcname, F.lit("")), F.format_string("S/N=%.1f", snr), F.regexp_replace(part, "unknown", "??"))
    return F.translate(text, "{}", "()")


def annotation_lines(ra: Column, dec: Column, label: Column, radius: float = 20.0) -> Column:
    """An array of lines of a kvis annotation file: a circle in degrees, and the label a little beside it."""
    deg = radius / 3600
    circle = F.format_string("CIRCLE %.6f %.6f %.6f", ra, dec, F.lit(deg))
    text = F.format_string("TEXT %.6f %.6f %s", ra + deg * 1.2, dec, F.translate(label, "{}", "()"))
    return F.when(F.coalesce(label, F.lit("")) != "", F.array(circle, text)).otherwise(F.array(circle))


def component_match(rows: DataFrame, names: DataFrame, spots: DataFrame, arcsec: float = 35.0, sub_rows: DataFrame | None = None) -> DataFrame:
    """Ids of rows (id, srcname, ra, dec) that bear a name, or lie flat within arcsec of a spot (ra, dec): two joins, so no nested loop over an OR.

    The spots are a cluster's few members; cells of declination pair them.  Where nothing matches, the ids of
    sub_rows, where they are given.
    """
    by_name = rows.join(names.select("srcname").distinct(), "srcname", "left_semi").select("id")
    edge = arcsec / 3600
    a = rows.select("id", "ra", "dec", F.floor(F.col("dec") / edge).alias("cell"))
    b = spots.select(F.col("ra").alias("sra"), F.col("dec").alias("sdec"), F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda k: F.floor(F.col("dec") / edge) + k)).alias("cell"))
    by_place = a.join(b, "cell").where(flat_separation(F.col("sra"), F.col("sdec"), F.col("ra"), F.col("dec")) <= arcsec).select("id")
    found = by_name.unionAll(by_place).distinct()
    if sub_rows is None:
        return found
    some = found.agg((F.count(F.lit(1)) > 0).alias("some"))
    return found.unionAll(sub_rows.select("id").distinct().join(F.broadcast(some), ~F.col("some")).select("id"))


def artefact_match(artefacts: DataFrame, names: DataFrame, kind: str | None = None) -> DataFrame:
    """(artefact, srcname): file names (artefact) that hold `cand_NAME`, `_NAME_` or `_NAME.` of a name (srcname).

    What follows an underscore or `cand_` in a file name, cut to the lengths that names have, is joined to
    the names: an equi-join, not every file against every name.  kind leaves out files of other families.
    """
    given = names.where("srcname <> ''").select("srcname").distinct()
    sizes = sorted(r[0] for r in given.select(F.length("srcname")).where(F.length("srcname") <= 255).distinct().collect())  # a file name has 255 characters at most
    files = family_filter(artefacts.select("artefact").distinct(), kind) if kind else artefacts.select("artefact").distinct()
    starts = F.expr("filter(sequence(2, greatest(2, length(artefact))), i -> substring(artefact, i - 1, 1) = '_')")
    cut = files.select("artefact", F.explode(starts).alias("i")).withColumn("size", F.explode(F.lit(sizes).cast("array<int>")))
    cut = cut.withColumns({"srcname": F.expr("substring(artefact, i, size)"), "then": F.expr("substring(artefact, i + size, 1)"), "cand": F.expr("i > 5 and substring(artefact, i - 5, 5) = 'cand_'")})
    fits = (F.length("srcname") == F.col("size")) & (F.col("cand") | F.col("then").isin("_", "."))
    return cut.where(fits).select("artefact", "srcname").join(given, "srcname", "left_semi").select("artefact", "srcname").distinct()


# Marks of other families in file names, by family.
OTHER_FAMILIES = {
    "boxcar": ("_var_", "_variance_", "_periodicity_", "_period_"),
    "variance": ("_boxcar_", "_box_", "_periodicity_", "_period_"),
    "periodicity": ("_boxcar_", "_box_", "_var_", "_variance_"),
}


def family_filter(files: DataFrame, kind: str, name: str = "artefact") -> DataFrame:
    """File names without a mark of another family, in any case."""
    return files.where(~F.lower(name).rlike("|".join(OTHER_FAMILIES[kind])))


def members(clustered: DataFrame, chosen: DataFrame) -> DataFrame:
    """All rows of the chosen components."""
    return clustered.join(chosen.select("component").distinct(), "component", "left_semi")


def continuum_lookup(beams: DataFrame, files: DataFrame) -> DataFrame:
    """(beam, file): the first file name, in order, that holds the beam's label; else the first of all, NULL if there is none.

    files is the list of one folder: it is broadcast as one array of names.
    """
    listed = files.agg(F.array_sort(F.collect_set("file")).alias("files"))
    own = F.get(F.filter("files", lambda f: f.contains(F.col("beam"))), F.lit(0))
    return beams.select("beam").distinct().join(F.broadcast(listed)).select("beam", F.coalesce(own, F.get("files", F.lit(0))).alias("file"))


def annotate(det: DataFrame, nx: int, ny: int, dx: float, dy: float, ra0: float, dec0: float, field: str = "", flip_u: bool = True, flip_v: bool = True) -> DataFrame:
    """Detections (x, y, ...) with l, m, ra_rad, dec_rad, ra_hms, dec_dms, srcname and the phase centre's field."""
    l, m = lm_from_xy(F.col("x"), F.col("y"), nx, ny, dx, dy, flip_u, flip_v)  # noqa: E741
    got = det.withColumns({"l": l, "m": m})
    ra, dec = radec_from_lm(F.col("l"), F.col("m"), ra0, dec0)
    got = got.withColumns({"ra_rad": ra, "dec_rad": dec})
    hms, dms = sexagesimal(F.col("ra_rad"), F.col("dec_rad"))
    got = got.withColumns({"ra_hms": hms, "dec_dms": dms})
    return got.withColumns({"srcname": source_name(F.col("ra_hms"), F.col("dec_dms")), "phase_center_field": F.lit(field)})


def fill_sexagesimal(df: DataFrame, ra: str = "ra_deg", dec: str = "dec_deg") -> DataFrame:
    """ra_hms and dec_dms where they are missing or empty, from degrees."""
    hms, dms = sexagesimal(F.radians(ra), F.radians(dec))
    have = lambda c: F.nullif(F.col(c), F.lit("")) if c in df.columns else F.lit(None).cast("string")
    return df.withColumns({"ra_hms": F.coalesce(have("ra_hms"), hms), "dec_dms": F.coalesce(have("dec_dms"), dms)})


def safe_name(name: Column) -> Column:
    """A source name as a folder's name."""
    return F.replace(name, F.lit("/"), F.lit("_"))


def union_by_name(*parts: DataFrame) -> DataFrame:
    """All rows, with NULL where a part lacks a column."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


# Candidate catalogue: column, type, and what stands for a missing value at a sink.
CANDIDATE = [
    ("srcname", "string", ""), ("x", "bigint", -1), ("y", "bigint", -1), ("l", "double", None), ("m", "double", None), ("ra_rad", "double", None), ("dec_rad", "double", None), ("ra_deg", "double", None), ("dec_deg", "double", None),
    ("ra_hms", "string", ""), ("dec_dms", "string", ""), ("snr", "double", None), ("width_samples", "bigint", -1), ("time_start", "double", None), ("time_end", "double", None), ("time_center", "double", None), ("duration", "double", None),
    ("t0_idx", "bigint", -1), ("t1_idx_excl", "bigint", -1), ("center_idx", "bigint", -1), ("scan_id", "bigint", -1), ("phase_center_field", "string", ""),
]


PERIODICITY = [c for c in CANDIDATE if c[0] in ("srcname", "x", "y", "l", "m", "ra_rad", "dec_rad", "ra_deg", "dec_deg", "ra_hms", "dec_dms", "snr")] + [
    ("f_hz", "double", None), ("period_s", "double", None), ("nharm_used", "bigint", 1), ("algo", "string", "periodicity"), ("phase_center_field", "string", ""),
]


def candidate_table(det: DataFrame, columns: list[tuple] | None = None) -> DataFrame:
    """Detections with a catalogue's fixed columns (CANDIDATE, or PERIODICITY); degrees follow from radians; what is missing gets its default."""
    have = set(det.columns)

    def col(name, kind, default):
        if name in ("ra_deg", "dec_deg") and name not in have and name.replace("deg", "rad") in have:
            return F.degrees(name.replace("deg", "rad"))
        c = F.col(name) if name in have else F.lit(None)
        return F.coalesce(c.cast(kind), F.lit(default).cast(kind))

    return det.select(*(col(*c).alias(c[0]) for c in columns or CANDIDATE))
