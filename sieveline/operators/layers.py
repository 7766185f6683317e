"""Layers of an architecture: which layer a file belongs to, and which imports cross forbidden borders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import file_name, stem

#: Generic layers and what their folders are called.
GENERIC = {
    "controller": ("controller", "handler", "view", "route"),
    "service": ("service", "usecase", "business", "application"),
    "repository": ("repository", "dao", "mapper", "data"),
    "model": ("model", "entity", "domain", "schema"),
    "infrastructure": ("infra", "util", "config", "middleware", "common"),
}
GRAM = 4

LAYER = "struct<name:string,responsibility:string,modules:array<string>,allowed_dependencies:array<string>,forbidden_dependencies:array<string>>"
LAYERS = f"struct<architecture:struct<layers:array<{LAYER}>>,layers:array<{LAYER}>>"


def layers_of(designs: DataFrame, json: str = "json") -> DataFrame:
    """(pos, name, forbidden, allowed) of a design document; unnamed layers are left out, of equal names the last counts, at the place of the first."""
    doc = F.from_json(json, LAYERS)
    listed = F.when(F.size(F.coalesce(doc["architecture"]["layers"], F.array().cast(f"array<{LAYER}>"))) > 0, doc["architecture"]["layers"]).otherwise(doc["layers"])
    rows = designs.select(F.posexplode(listed).alias("pos", "layer")).where("layer.name != ''")
    last = F.max_by("layer", "pos")
    empty = F.array().cast("array<string>")
    return rows.groupBy("layer.name").agg(F.min("pos").alias("pos"), last.alias("layer")).select("pos", "name", F.coalesce("layer.forbidden_dependencies", empty).alias("forbidden"), F.coalesce("layer.allowed_dependencies", empty).alias("allowed"))


def layer_list(layers: DataFrame) -> list[tuple[str, list[str]]]:
    """(name, forbidden layers) in order.  One design's layers: as many rows as the document lists."""
    return [(r["name"], list(r["forbidden"])) for r in layers.orderBy("pos").collect()]


def matching_layer(generic: str, names: list[str]) -> str | None:
    return next((n for n in names if generic in n.lower() or n.lower() in generic), None)


def layer_of(path: Column, names: list[str]) -> Column:
    """The layer of a file: the first that its path names, else the last generic one that its folder's name tells of."""
    lower = F.lower(F.regexp_replace(path, r"\\", "/"))
    by_name = [F.when(F.contains(lower, F.lit(n.lower())), F.lit(n)) for n in names]
    parts = F.split(lower, "/")
    parent = F.when(F.size(parts) > 1, F.get(parts, F.size(parts) - 2))
    by_folder = []
    for generic, words in GENERIC.items():
        layer = matching_layer(generic, names)
        if layer is not None:
            told = F.lit(False)
            for w in words:
                told = told | F.contains(parent, F.lit(w))
            by_folder.insert(0, F.when(told, F.lit(layer)))
    options = by_name + by_folder
    return F.coalesce(*options) if options else F.lit(None).cast("string")


def file_layers(files: DataFrame, names: list[str]) -> DataFrame:
    """files (path) with layer, null where nothing tells it."""
    return files.withColumn("layer", layer_of(F.col("path"), names))


def placed_files(files: DataFrame, names: list[str]) -> DataFrame:
    """(path, layer) of files that have one.  The array keeps the optimizer from repeating the long expression wherever layer is used."""
    return files.select("path", F.explode(F.filter(F.array(layer_of(F.col("path"), names)), lambda x: x.isNotNull())).alias("layer"))


def grams_of(text: Column, size: int) -> Column:
    """All substrings of that many characters."""
    every = F.transform(F.sequence(F.lit(1), F.length(text) - size + 1), lambda i: F.substring(text, i, F.lit(size)))
    return F.when(F.length(text) >= size, F.array_distinct(every)).otherwise(F.array().cast("array<string>"))


def imported_files(edges: DataFrame, files: DataFrame) -> DataFrame:
    """edges (path, seq, module) with target: the first file of that name, else the first whose path has the dotted path, else null.

    A dotted path of up to GRAM characters is looked up in a table of the first
    file of each substring of that size; a longer one meets only the paths that
    have its rarest substring of GRAM characters.
    """
    name = F.element_at(F.split("module", r"\."), -1)
    by_stem = files.select(stem(file_name(F.col("path"))).alias("_name"), "path").groupBy("_name").agg(F.min("path").alias("_first"))
    joined = edges.withColumn("_name", name).join(by_stem, "_name", "left")
    missing = joined.where("_first IS NULL").select("module").distinct().withColumn("_path", F.replace("module", F.lit("."), F.lit("/")))
    texts = files.select("path", F.replace(F.lower(F.regexp_replace("path", r"\\", "/")), F.lit(".py"), F.lit("")).alias("_text"))
    short, long = missing.where(F.length("_path") <= GRAM), missing.where(F.length("_path") > GRAM)
    sizes = [grams_of(F.col("_text"), n) for n in range(1, GRAM + 1)]
    # Only substrings that some module asks for are kept, and counted before rows meet by them.
    asked = short.select(F.col("_path").alias("_gram")).distinct()
    first = texts.select("path", F.explode(F.flatten(F.array(*sizes))).alias("_gram")).join(asked, "_gram", "left_semi").groupBy("_gram").agg(F.min("path").alias("_second"))
    by_short = short.join(first, F.col("_path") == F.col("_gram")).select("module", "_second")
    wanted = long.select("module", "_path", F.explode(grams_of(F.col("_path"), GRAM)).alias("_gram"))
    held = texts.select("path", "_text", F.explode(grams_of(F.col("_text"), GRAM)).alias("_gram"))
    # A substring that no path has counts 0, so its module finds nothing.
    often = held.select("_gram").join(wanted.select("_gram").distinct(), "_gram", "left_semi").groupBy("_gram").agg(F.count("*").alias("_n"))
    rarest = wanted.join(often, "_gram", "left").groupBy("module", "_path").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_gram").alias("g"))).alias("_r"))
    rarest = rarest.where("_r.n > 0").select("module", "_path", F.col("_r.g").alias("_gram"))
    by_long = rarest.join(held, "_gram").where(F.contains("_text", F.col("_path"))).groupBy("module").agg(F.min("path").alias("_second"))
    return joined.join(by_short.unionByName(by_long), "module", "left").select("path", "seq", "module", F.coalesce("_first", "_second").alias("target"))


def violations(edges: DataFrame, files: DataFrame, layers: list[tuple[str, list[str]]]) -> DataFrame:
    """(path, seq, module, layer, target, target_layer) of imports that their layer forbids; an import that occurs twice counts twice."""
    placed = placed_files(files.select("path"), [n for n, _ in layers])
    theirs = placed.select(F.col("path").alias("target"), F.col("layer").alias("target_layer"))
    crossing = imported_files(edges, files).join(placed, "path").join(theirs, "target").where("target_layer != layer")
    barred = {name: forbidden for name, forbidden in layers if forbidden}
    if not barred:
        return crossing.limit(0).select("path", "seq", "module", "layer", "target", "target_layer")
    of_layer = F.create_map(*[x for name, forbidden in barred.items() for x in (F.lit(name), F.array(*map(F.lit, forbidden)))])
    return crossing.where(F.array_contains(F.try_element_at(of_layer, F.col("layer")), F.col("target_layer"))).select("path", "seq", "module", "layer", "target", "target_layer")


def import_lines(found: DataFrame, lines: DataFrame) -> DataFrame:
    """found (path, module, ...) with line_no: the first line that has the module and the word import or from; 0 if none has."""
    candidates = lines.where(F.contains("line", F.lit("import")) | F.contains("line", F.lit("from"))).select(F.col("path").alias("_path"), "line_no", "line")
    wanted = found.select("path", "module").distinct()
    first = wanted.join(candidates, (F.col("path") == F.col("_path")) & F.contains("line", F.col("module"))).groupBy("path", "module").agg(F.min("line_no").alias("line_no"))
    return found.join(first, ["path", "module"], "left").withColumn("line_no", F.coalesce("line_no", F.lit(0)))
