"""Reconciliation of records: three-way merge, last writer wins, snapshots, and resolution of conflicts.

A merge takes three tables of the same columns, with one row a key (of more, the one with the largest form counts). Rows
are compared by their forms (``velum.functions.structure``): null equals null, maps are equal whatever the order of their
entries at any depth, and so are JSON texts in the columns that are named as such. Values that are equal in form but
spelled differently count as unchanged, and keep the ancestor's spelling. Each merge shuffles its rows once, by their key.
"""

from __future__ import annotations

from collections.abc import Callable, Collection, Sequence
from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructField, StructType

from velum.functions.structure import form, is_plain, same

ARRAY_FIELDS = ("emails", "names", "usernames", "hostnames", "phones", "email_domains")
DEFAULT_SNAPSHOTS = 10


def three_sides(ancestor: DataFrame, local: DataFrame, remote: DataFrame, keys: Sequence[str], json: Collection[str] = ()) -> DataFrame:
    """keys, the structs a, l and r of each side's other columns, and their forms fa, fl and fr; a side without the key is
    null. ``json`` names columns that hold JSON text. One shuffle by the keys of all three, instead of two full outer joins
    with one of their result in between. It comes before the forms and the aggregate, which sorts rows of such types: a
    split of a well packed file may hold millions of rows, and so may partitions that Spark puts together by their
    compressed size, which is why their number is given."""
    values = [c for c in ancestor.columns if c not in keys]
    side = lambda df, n: df.select(*keys, F.lit(n).alias("side"), F.struct(*values).alias("row"))
    dealt = int(ancestor.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = side(ancestor, 0).unionByName(side(local, 1)).unionByName(side(remote, 2)).repartition(dealt, *keys)
    kind = rows.schema["row"].dataType
    own = lambda n, c: F.when(F.col("side") == n, F.col(c))
    names = ("a", "l", "r")
    if is_plain(kind) and not json:
        found = rows.groupBy(*keys).agg(*[F.max(own(n, "row")).alias(name) for n, name in enumerate(names)])
        return found.select("*", *[F.col(name).alias(f"f{name}") for name in names])
    rows = rows.withColumn("form", form(F.col("row"), kind, json))
    kept = [F.max_by(own(n, "row"), own(n, "form")).alias(name) for n, name in enumerate(names)]
    return rows.groupBy(*keys).agg(*kept, *[F.max(own(n, "form")).alias(f"f{name}") for n, name in enumerate(names)])


def _nullable(kind: DataType) -> DataType:
    if isinstance(kind, StructType):
        return StructType([StructField(f.name, _nullable(f.dataType)) for f in kind.fields])
    if isinstance(kind, MapType):
        return MapType(kind.keyType, _nullable(kind.valueType))
    return ArrayType(_nullable(kind.elementType)) if isinstance(kind, ArrayType) else kind


Forms = tuple[Column, Column, Column] | None


def merged(a: Column, l: Column, r: Column, forms: Forms = None) -> Column:  # noqa: E741
    """The value that a three-way merge keeps; null if the record is gone. Where both sides changed it, or one changed
    what the other deleted, the local value stays, or the one that is left. ``forms`` are compared instead of the values."""
    x, y, z = forms or (a, l, r)
    return (
        F.when(a.isNull(), F.coalesce(l, r))
        .when(l.isNull() & r.isNull(), l)
        .when(l.isNull(), F.when(~x.eqNullSafe(z), r))
        .when(r.isNull(), F.when(~x.eqNullSafe(y), l))
        .otherwise(field_merged(a, l, r, forms))
    )


def conflicting(a: Column, l: Column, r: Column) -> Column:  # noqa: E741
    """Whether the sides, or their forms, disagree in a way that the rules don't settle."""
    both = l.isNotNull() & r.isNotNull() & ~l.eqNullSafe(r) & ~a.eqNullSafe(l) & ~a.eqNullSafe(r)
    deleted = a.isNotNull() & ((l.isNull() & r.isNotNull() & ~a.eqNullSafe(r)) | (r.isNull() & l.isNotNull() & ~a.eqNullSafe(l)))
    return both | deleted


def field_merged(a: Column, l: Column, r: Column, forms: Forms = None) -> Column:  # noqa: E741
    """The rule for a field that all sides have: the side that changed it; local if both did."""
    if forms is None:
        return F.when(a.eqNullSafe(l), r).otherwise(l)
    x, y, z = forms
    return F.when(x.eqNullSafe(y), F.when(x.eqNullSafe(z), a).otherwise(r)).when(x.eqNullSafe(z), l).otherwise(l)


def field_conflict(a: Column, l: Column, r: Column) -> Column:  # noqa: E741
    return ~a.eqNullSafe(l) & ~a.eqNullSafe(r) & ~l.eqNullSafe(r)


def _forms() -> tuple[Column, Column, Column]:
    return F.col("fa"), F.col("fl"), F.col("fr")


def merge(ancestor: DataFrame, local: DataFrame, remote: DataFrame, keys: Sequence[str], json: Collection[str] = ()) -> DataFrame:
    """The merged rows, with the columns of the inputs. ``json`` names columns of JSON text, equal if they say the same."""
    m = three_sides(ancestor, local, remote, keys, json).select(*keys, merged(F.col("a"), F.col("l"), F.col("r"), _forms()).alias("m"))
    return m.where("m is not null").select(*keys, "m.*")


def conflicts(ancestor: DataFrame, local: DataFrame, remote: DataFrame, keys: Sequence[str], path: str = "mappings", json: Collection[str] = ()) -> DataFrame:
    """id, path, local_value, remote_value, ancestor_value (JSON; null for a side without the record)."""
    a, l, r = F.col("a"), F.col("l"), F.col("r")  # noqa: E741
    found = three_sides(ancestor, local, remote, keys, json).where(conflicting(*_forms()))
    key = F.concat_ws(",", *[F.col(k).cast("string") for k in keys])
    return found.select(key.alias("id"), F.concat(F.lit(f"{path}["), key, F.lit("]")).alias("path"), F.to_json(l).alias("local_value"), F.to_json(r).alias("remote_value"), F.to_json(a).alias("ancestor_value"))


def merge_settings(ancestor: DataFrame, local: DataFrame, remote: DataFrame, unions: Sequence[str] = ("customDomains", "categories")) -> DataFrame:
    """Tables (key, value: JSON string) merged key by key: key, value, conflict, and the values local_value, remote_value
    and ancestor_value. A key that a side hasn't is null there; values are equal if their JSON says the same. The list keys
    in ``unions`` become the union of both sides, local first, whatever the ancestor had."""
    m = three_sides(ancestor.select("key", "value"), local.select("key", "value"), remote.select("key", "value"), ["key"], ["value"])
    a, l, r = F.col("a.value"), F.col("l.value"), F.col("r.value")  # noqa: E741
    forms = (F.col("fa.value"), F.col("fl.value"), F.col("fr.value"))
    items = lambda c: F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))
    union = F.col("key").isin(*unions)
    out = F.when(union, F.to_json(F.array_union(items(l), items(r)))).otherwise(field_merged(a, l, r, forms))
    return m.select("key", out.alias("value"), (~union & field_conflict(*forms)).alias("conflict"), l.alias("local_value"), r.alias("remote_value"), a.alias("ancestor_value"))


def merge_array(a: Column, l: Column, r: Column, forms: Forms = None) -> Column:  # noqa: E741
    """struct<merged, conflict> of array columns. If one side alone changed, its array; else position by position,
    where a missing element is null and isn't kept, and a clash keeps local and raises one conflict for the field. The
    arrays ``forms`` are compared instead, where elements aren't comparable themselves."""
    full = lambda c: F.coalesce(c, F.expr("array()"))
    a, l, r = map(full, (a, l, r))  # noqa: E741
    x, y, z = map(full, forms) if forms else (a, l, r)
    n = F.greatest(F.size(a), F.size(l), F.size(r))
    at = lambda c, i: F.get(c, i)
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    of = lambda i: (at(x, i), at(y, i), at(z, i))
    by_place = F.filter(F.transform(places, lambda i: field_merged(at(a, i), at(l, i), at(r, i), of(i) if forms else None)), lambda v: v.isNotNull())
    clash = F.exists(places, lambda i: field_conflict(*of(i)))
    one_side = x.eqNullSafe(y) | x.eqNullSafe(z)
    return F.struct(F.when(x.eqNullSafe(y), r).when(x.eqNullSafe(z), l).otherwise(by_place).alias("merged"), F.when(one_side, F.lit(False)).otherwise(clash).alias("conflict"))


def merge_profiles(ancestor: DataFrame, local: DataFrame, remote: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(merged profiles, conflicts: id, path, local_value, remote_value, ancestor_value, values in JSON). Whole profiles come and go by the rules of ``merge``; a profile that all
    sides have is merged field by field, array fields by position, the flags in ``enabled`` one by one."""
    sides = three_sides(ancestor, local, remote, [key])
    a, l, r = F.col("a"), F.col("l"), F.col("r")  # noqa: E741
    schema = ancestor.schema
    all_three = a.isNotNull() & l.isNotNull() & r.isNotNull()
    fields, clashes, flag_maps = [], [], []
    for f in (f for f in schema.fields if f.name != key):
        x, y, z = a[f.name], l[f.name], r[f.name]
        forms = tuple(c[f.name] for c in _forms())
        if f.name in ARRAY_FIELDS and isinstance(f.dataType, ArrayType):
            m = merge_array(x, y, z, None if is_plain(f.dataType) else forms)
            fields.append(m["merged"].cast(_nullable(f.dataType)).alias(f.name))
            clashes.append((f.name, m["conflict"], (x, y, z)))
        elif f.name == "enabled" and hasattr(f.dataType, "fields"):
            of = lambda g, sides: tuple(c[g.name] for c in sides)
            flags = [field_merged(*of(g, (x, y, z)), of(g, forms)).alias(g.name) for g in f.dataType.fields]
            by_flag = y.isNotNull() & z.isNotNull()
            fields.append(F.when(by_flag, F.struct(*flags)).otherwise(field_merged(x, y, z, forms)).alias(f.name))
            clashes += [(f"enabled.{g.name}", by_flag & field_conflict(*of(g, forms)), of(g, (x, y, z))) for g in f.dataType.fields]
            clashes.append((f.name, ~by_flag & field_conflict(*forms), (x, y, z)))
        elif f.name == "enabled" and isinstance(f.dataType, MapType):
            whole_field, by_key = field_merged(x, y, z, forms), y.isNotNull() & z.isNotNull()
            fields.append(F.when(by_key, _flags_merged(x, y, z)).otherwise(whole_field).alias(f.name))
            flag_maps.append((f.name, by_key, (x, y, z)))
            clashes.append((f.name, ~by_key & field_conflict(*forms), (x, y, z)))
        else:
            fields.append(field_merged(x, y, z, forms).alias(f.name))
            clashes.append((f.name, field_conflict(*forms), (x, y, z)))
    kind = _nullable(sides.schema["a"].dataType)
    own = F.when(all_three, F.struct(*fields).cast(kind)).otherwise(merged(a, l, r, _forms()).cast(kind))
    rows = sides.select(key, own.alias("m")).where("m is not null").select(key, "m.*")
    entry = "struct<field:string,local_value:string,remote_value:string,ancestor_value:string>"
    told = lambda name, x, y, z, shown: F.struct(name if isinstance(name, Column) else F.lit(name), shown(y), shown(z), shown(x)).cast(entry)
    by_field = F.filter(F.array(*[F.when(c, told(n, *v, _json)) for n, c, v in clashes]), lambda x: x.isNotNull())
    for name, there, sides_ in flag_maps:
        at = partial(_flag_told, told, name, sides_)
        by_field = F.concat(by_field, F.when(there, F.transform(_flags_in_conflict(*sides_), lambda k: at(k))).otherwise(F.array().cast(f"array<{entry}>")))
    full = lambda side: F.when(side.isNotNull(), F.to_json(F.struct(F.col(key), *[side[f.name].alias(f.name) for f in schema.fields if f.name != key])))
    whole = F.when(conflicting(*_forms()), F.array(told("", a, l, r, full))).otherwise(F.array().cast(f"array<{entry}>"))
    found = sides.select(key, F.inline(F.when(all_three, by_field).otherwise(whole)))
    dot = F.when(F.col("field") == "", "").otherwise(F.concat(F.lit("."), F.col("field")))
    ident = F.col(key).cast("string")
    values = ("local_value", "remote_value", "ancestor_value")
    return rows, found.select(F.concat(ident, dot).alias("id"), F.concat(F.lit("identity.profiles["), ident, F.lit("]"), dot).alias("path"), *values)


def _flag_told(told: Callable[..., Column], name: str, sides: tuple[Column, ...], key: Column) -> Column:
    return told(F.concat(F.lit(f"{name}."), key), *[F.try_element_at(c, key) for c in sides], _json)


def _flag_names(*sides: Column) -> Column:
    none = F.array().cast("array<string>")
    return F.array_sort(F.array_distinct(F.concat(*[F.coalesce(F.map_keys(c), none) for c in sides])))


def _flags_merged(a: Column, l: Column, r: Column) -> Column:  # noqa: E741
    """Maps of flags merged key by key; a key that a side hasn't is null there, and isn't kept if null comes out."""
    at = lambda k: tuple(F.try_element_at(c, k) for c in (a, l, r))
    entries = F.transform(_flag_names(a, l, r), lambda k: F.struct(k, field_merged(*at(k)).alias("value")))
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


def _flags_in_conflict(a: Column, l: Column, r: Column) -> Column:  # noqa: E741
    return F.filter(_flag_names(a, l, r), lambda k: field_conflict(*(F.try_element_at(c, k) for c in (a, l, r))))


def _json(value: Column) -> Column:
    """A value of any type as JSON; null for null."""
    return F.when(value.isNotNull(), F.regexp_extract(F.to_json(F.struct(value.alias("v"))), r'(?s)^\{"v":(.*)\}\z', 1))


#: The parts of a configuration, in the order in which their conflicts are reported.
PARTS = ("mappings", "settings", "identity")


def merge_data(ancestor: Sequence[DataFrame], local: Sequence[DataFrame], remote: Sequence[DataFrame]) -> tuple[dict[str, DataFrame], DataFrame]:
    """A whole configuration merged. Each side is its three tables: mappings (id, ...), settings (key, value: JSON) and
    profiles (id, ...). The result are the merged tables by part, and all conflicts: part (its number, by which they are
    in order), id, path, local_value, remote_value, ancestor_value."""
    m, s, p = zip(ancestor, local, remote, strict=True)
    settings = merge_settings(*s)
    profiles, clashes = merge_profiles(*p)
    values = ("local_value", "remote_value", "ancestor_value")
    by_key = settings.where("conflict").select(F.col("key").alias("id"), F.concat(F.lit("settings."), "key").alias("path"), *values)
    every = [c.select(F.lit(k).alias("part"), "id", "path", *values) for k, c in enumerate((conflicts(*m, ["id"]), by_key, clashes))]
    return {"mappings": merge(*m, ["id"]), "settings": settings.select("key", "value"), "identity": profiles}, every[0].unionByName(every[1]).unionByName(every[2])


def deep_equal(x: Column, y: Column, kind: DataType) -> Column:
    """Equality of values of any type, with maps at any depth, whatever the order of their entries."""
    return same(x, y, kind)


def _one_each(choices: DataFrame, key: str = "path") -> DataFrame:
    """One value for each path that is chosen: of several the largest, null only if there is no other."""
    return choices.groupBy(key).agg(F.max("value").alias("value"))


def resolve(merged_rows: DataFrame, choices: DataFrame, key: str, path: str = "mappings") -> DataFrame:
    """``merged_rows`` after ``choices`` (path, value: JSON or null): a row whose path is chosen takes the value, or goes
    if that is null; a value for a key that isn't there is added. Of several choices for a path the largest value counts."""
    columns = merged_rows.columns
    kind = merged_rows.schema
    chosen = _one_each(choices).select(F.regexp_extract("path", rf"^{path.replace('.', '[.]')}\[(.*)\]\z", 1).alias("choice_key"), F.from_json("value", kind).alias("choice")).where("choice_key <> ''")
    joined = merged_rows.join(chosen, merged_rows[key].cast("string") == chosen.choice_key, "full")
    taken = F.when(F.col("choice_key").isNull(), F.struct(*[merged_rows[c] for c in columns])).otherwise(F.col("choice"))
    return joined.select(taken.alias("m")).where("m is not null").select("m.*")


def resolve_settings(settings: DataFrame, choices: DataFrame) -> DataFrame:
    """``settings`` (key, value: JSON) after those of ``choices`` (path, value) whose path is ``settings.key``."""
    chosen = _one_each(choices).select(F.regexp_extract("path", r"(?s)^settings\.(.+)\z", 1).alias("key"), "value").where("key <> ''")
    return upsert(settings.select("key", "value"), chosen, "key")


def resolve_fields(profiles: DataFrame, choices: DataFrame, key: str = "id") -> DataFrame:
    """``profiles`` after those of ``choices`` (path, value: JSON or null) whose path is
    ``identity.profiles[id].field`` or ``.field.part``; a path that no profile or column has changes nothing."""
    at = lambda k: F.regexp_extract("path", r"(?s)^identity\.profiles\[(.+?)\]\.(.+)\z", k)
    chosen = _one_each(choices).select(at(1).alias("choice_key"), at(2).alias("field"), "value").where("choice_key <> ''")
    chosen = chosen.groupBy("choice_key").agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("chosen"))
    joined = profiles.join(chosen, profiles[key].cast("string") == chosen["choice_key"], "left")

    def taken(old: Column, kind: DataType, name: str) -> Column:
        if isinstance(kind, StructType):
            old = F.when(old.isNotNull(), F.struct(*[taken(old[f.name], f.dataType, f"{name}.{f.name}").alias(f.name) for f in kind.fields]))
        new = F.from_json(F.concat(F.lit('{"v":'), F.coalesce(F.try_element_at("chosen", F.lit(name)), F.lit("null")), F.lit("}")), StructType().add("v", kind))["v"]
        return F.when(F.map_contains_key("chosen", name), new).otherwise(old)

    own = [profiles[f.name] if f.name == key else taken(profiles[f.name], f.dataType, f.name).alias(f.name) for f in profiles.schema.fields]
    return joined.select(*own)


def resolve_data(parts: dict[str, DataFrame], choices: DataFrame) -> dict[str, DataFrame]:
    """The tables of ``merge_data`` after ``choices`` (path, value: JSON or null), whatever part their paths are in."""
    whole = resolve(parts["identity"], choices, "id", "identity.profiles")
    return {"mappings": resolve(parts["mappings"], choices, "id"), "settings": resolve_settings(parts["settings"], choices), "identity": resolve_fields(whole, choices)}


def last_writer_wins(local: DataFrame, remote: DataFrame, keys: Sequence[str], modified: str) -> DataFrame:
    """The newer row of each key; a tie keeps local. One shuffle, with the best row of each side chosen before it."""
    both = local.withColumn("is_local", F.lit(1)).unionByName(remote.withColumn("is_local", F.lit(0)))
    values = [c for c in local.columns if c not in keys]
    best = both.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(F.col(modified), F.col("is_local"))).alias("best"))
    return best.select(*keys, "best.*")


def latest(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key by ``order``."""
    values = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("best")).select(*keys, "best.*")


def prune(snapshots: DataFrame, keep: int = DEFAULT_SNAPSHOTS, by: Sequence[str] = (), ts: str = "ts", ident: str = "id") -> DataFrame:
    """The newest ``keep`` snapshots (of each group); under 1 keeps all. Equal times go by the larger id. Without groups
    it is a top-k, not a sort of everything in one task."""
    if keep < 1:
        return snapshots
    if not by:
        return snapshots.orderBy(F.desc(ts), F.desc(ident)).limit(keep)
    w = Window.partitionBy(*by).orderBy(F.desc(ts), F.desc(ident))
    return snapshots.withColumn("place_in_group", F.row_number().over(w)).where(F.col("place_in_group") <= keep).drop("place_in_group")


def first_seen(rows: DataFrame, key: str, ordinal: str) -> DataFrame:
    """The first row of each key, by an aggregate that combines before the shuffle."""
    values = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.min_by(F.struct(*values), ordinal).alias("first")).select(key, "first.*").select(*rows.columns)


def upsert(rows: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """``rows`` with those of ``changes`` in place of rows of the same key."""
    return rows.join(changes.select(key), key, "left_anti").unionByName(changes)


def remove(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return rows.join(keys.select(key), key, "left_anti")
