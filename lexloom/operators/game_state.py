"""Names, variables, maps and tiles of a running game."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The first ids of the kinds of tiles, the pages of their pictures, the size of a tile.
TILES = {"A5": 1536, "A1": 2048, "A2": 2816, "A3": 4352, "A4": 5888}
TILE_END, PAGE_B, PAGE_A5, TILE, SHAPES = 8192, 5, 4, 48, 48


def display_names(indices: DataFrame, original: DataFrame, translated: DataFrame, manual: DataFrame, kind: str = "Variable") -> DataFrame:
    """idx, name: a manual name, else the translated and the original one, else `kind #idx`. The sides have idx and name."""
    side = lambda df, n: df.where(F.col("name") != "").groupBy("idx").agg(F.max("name").alias(n))
    rows = indices.select("idx").join(side(original, "o"), "idx", "left").join(side(translated, "t"), "idx", "left").join(side(manual, "m"), "idx", "left")
    own = F.coalesce("o", F.concat(F.lit(f"{kind} #"), "idx"))
    return rows.select("idx", F.coalesce("m", F.when(F.col("t") != own, F.concat("t", F.lit(" · "), own)), own).alias("name"))


def variable_view(rows: DataFrame, want_bool: bool | None = None, hide_text: bool = False, search: str = "") -> DataFrame:
    """rows (name, kind, value; kind: bool, text, or another) that pass the switches and hold the search in name or value."""
    q, kind = F.lit(search.lower()), F.col("kind")
    rule = F.contains(F.lower("name"), q) | F.contains(F.lower(F.col("value").cast("string")), q)
    if want_bool is not None:
        rule = rule & ((kind == "bool") == F.lit(want_bool))
    return rows.where(rule & (kind != "text") if hide_text else rule)


def by_lower_name(rows: DataFrame, order: str) -> DataFrame:
    return rows.orderBy(F.lower("name"), order)


def coerced(old_kind: Column, text: Column) -> Column:
    """struct(ok, value): text as a value of the old one's kind (bool, int, float, text), written in one form."""
    t = F.lower(F.trim(text))
    flag = F.when(t.isin("true", "1", "yes"), "true").when(t.isin("false", "0", "no"), "false")
    value = F.when(old_kind == "bool", flag).when(old_kind == "int", F.trim(text).try_cast("bigint").cast("string")).when(old_kind == "float", F.trim(text).try_cast("double").cast("string")).otherwise(text)
    return F.struct(value.isNotNull().alias("ok"), value.alias("value"))


def first_at(events: DataFrame, places: DataFrame) -> DataFrame:
    """places (x, y) with id, the first event (by ord) there, else null."""
    first = events.groupBy("x", "y").agg(F.min_by("id", "ord").alias("id"))
    return places.join(first, ["x", "y"], "left")


def next_id(events: DataFrame) -> DataFrame:
    return events.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).alias("next_id"))


def command_names(commands: DataFrame, catalog: DataFrame) -> DataFrame:
    """commands (id, code) with name: the catalog's (code, name), else `Command code`."""
    return commands.join(catalog.select("code", F.col("name").alias("known")), "code", "left").select("id", "code", F.coalesce("known", F.concat(F.lit("Command "), "code")).alias("name"))


def map_search(maps: DataFrame, query: str) -> DataFrame:
    """Maps (id, name) whose name holds the query or whose id it is."""
    q = query.strip().lower()
    return maps.where(F.contains(F.lower("name"), F.lit(q)) | (F.col("id").cast("string") == q))


def map_layers(data: Column, cells: Column) -> Column:
    """struct(lower, upper, shadow, region) of a map's flat array: two, two, one and one layers; of five layers the region is missing, of four the second upper one, too."""
    layer = lambda a, n: F.slice(data, cells * a + 1, cells * n)
    none = F.array().cast("array<int>")
    many = F.when(cells > 0, F.floor(F.size(data) / cells)).otherwise(0)
    of = lambda *ways: F.when(many >= 6, ways[0]).when(many == 5, ways[1]).when(many == 4, ways[2]).otherwise(none)
    return F.struct(
        F.when(many >= 4, layer(0, 2)).otherwise(none).alias("lower"),
        of(layer(2, 2), layer(2, 2), layer(2, 1)).alias("upper"),
        of(layer(4, 1), layer(4, 1), layer(3, 1)).alias("shadow"),
        of(layer(5, 1), none, none).alias("region"),
    )


def tile_class(tile: Column) -> Column:
    """struct(sheet, page, x, y, kind, shape): for plain tiles the page and place of the picture, for automatic ones kind and shape; null outside."""
    n = F.when(tile < TILES["A5"], F.pmod(tile, F.lit(256))).otherwise(tile - TILES["A5"])
    div = lambda a, b: F.floor(a / b).cast("int")
    low, auto = tile < TILES["A5"], tile >= TILES["A1"]
    sheet = F.when(low, F.substring(F.lit("BCDE  "), div(tile, 256) + 1, F.lit(1)))
    for name, first in TILES.items():
        sheet = F.when(tile >= first, name).otherwise(sheet) if name != "A5" else F.when(~low, name).otherwise(sheet)
    x = F.when(low, (div(n, 128) % 2 * 8 + n % 8) * TILE).otherwise(n % 8 * TILE)
    y = F.when(low, div(n, 8) % 16 * TILE).otherwise(div(n, 8) * TILE)
    page = F.when(low, PAGE_B + div(tile, 256)).otherwise(PAGE_A5)
    plain = lambda c: F.when(~auto, c.cast("int")).alias
    out = F.struct(F.trim(sheet).alias("sheet"), plain(page)("page"), plain(x)("x"), plain(y)("y"), F.when(auto, div(tile - TILES["A1"], SHAPES)).alias("kind"), F.when(auto, ((tile - TILES["A1"]) % SHAPES).cast("int")).alias("shape"))
    return F.when((tile > 0) & (tile < TILE_END), out)


def fixed_batches(rows: DataFrame, group: list[str], order: str, size: int) -> DataFrame:
    """rows with batch: so many in a row of each group's order (a conversation, a file) go together."""
    w = Window.partitionBy(*group).orderBy(order)
    return rows.withColumn("batch", F.floor((F.row_number().over(w) - 1) / size).cast("int"))


def distinct_until_changed(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """The first row of each key, and those whose value differs from the one before (null is a value)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    first = F.row_number().over(w) == 1
    return rows.withColumn("new__", first | ~F.col(value).eqNullSafe(F.lag(value).over(w))).where("new__").drop("new__")
