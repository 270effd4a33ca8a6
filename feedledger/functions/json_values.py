"""Typing and printing of JSON values held as variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from feedledger.functions.scalars import truncate_text

# The class names messages use for each kind of JSON value.
CLASS_NAMES = {
    "null": "NilClass", "object": "Hash", "array": "Array", "string": "String",
    "integer": "Integer", "float": "Float", "true": "TrueClass", "false": "FalseClass",
}


# Variant shapes whose kind needs no look at the token.
PLAIN_SHAPES = ("STRING", "BIGINT", "VOID", "BOOLEAN")


def kind_sql(shape: str, token: str) -> str:
    """SQL for the kind of a value from the shape of its variant: object, array, string,
    integer, float, boolean, null or absent.

    A number the variant stores as a 64-bit integer was written as one. Any other number
    is an integer only if its token is all digits.
    """
    return (f"CASE WHEN {shape} IS NULL THEN 'absent' WHEN {shape} = 'STRING' THEN 'string' "
            f"WHEN {shape} = 'BIGINT' THEN 'integer' WHEN {shape} = 'VOID' THEN 'null' "
            f"WHEN {shape} = 'BOOLEAN' THEN 'boolean' WHEN {shape} LIKE 'OBJECT%' THEN 'object' "
            f"WHEN {shape} LIKE 'ARRAY%' THEN 'array' WHEN {token} RLIKE '^-?[0-9]+$' THEN 'integer' "
            "ELSE 'float' END")


def filled_sql(name: str) -> str:
    """SQL test for a field read by ``with_fields``: a string with something in it.

    A first character that is no white space spares the pattern.
    """
    return f"(k_{name} = 'string' AND (ascii(s_{name}) BETWEEN 33 AND 126 OR s_{name} RLIKE '(?U)\\\\S'))"


def with_fields(df: DataFrame, paths: dict[str, str], containers: tuple[str, ...] = (), value: str = "value",
                text: str = "text", keep: list[str] | None = None, extra: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``k_`` (JSON kind) and ``s_`` (value as text) columns for every path of a variant.

    ``text`` names the exact text of documents the variant alone would not print exactly,
    null for all others. Every path is looked up once and every shape is taken once, in
    layers, so later rules are comparisons of short strings. The layers are SQL text:
    building a hundred small expressions one call at a time takes longer than running them.
    """
    keep = df.columns if keep is None else keep
    members: dict[str, dict[str, str]] = {}  # by the container that holds them: key to field
    for name, path in paths.items():
        owner, key = path.rsplit(".", 1)
        members.setdefault(owner, {})[key] = name
    held = {path: name for name, path in paths.items() if path in members}

    def opened(variant: str, owner: str) -> str:
        return (f"try_variant_get({variant}, '$', 'struct<" + ",".join(f"`{key}`:variant" for key in members[owner]) + ">')")

    # An object is taken apart once, into all fields that are looked at; null where it is none.
    found = df.selectExpr("*", f"{opened(value, '$')} AS o_document")
    found = found.selectExpr("*", *[f"o_document.`{key}` AS v_{name}" for key, name in members["$"].items()])
    found = found.selectExpr("*", *[f"{opened(f'v_{name}', path)} AS o_{name}" for path, name in held.items()])
    found = found.selectExpr("*", *[f"o_{name}.`{key}` AS v_{field}" for path, name in held.items()
                                    for key, field in members[path].items()])
    shapes = {name: f"schema_of_variant(v_{name})" for name in paths} | {"document": f"schema_of_variant({value})"}
    for name in (*held.values(), "document"):
        shapes[name] = f"CASE WHEN o_{name} IS NOT NULL THEN 'OBJECT' ELSE {shapes[name]} END"
    shaped = found.selectExpr("*", *[f"{shape} AS t_{name}" for name, shape in shapes.items()])
    plain = ", ".join(f"'{shape}'" for shape in PLAIN_SHAPES)

    def token(name: str) -> str:
        return f"get_json_object({text}, '{paths[name]}')"

    return shaped.selectExpr(
        *keep, f"{kind_sql('t_document', text)} AS k_document",
        *[f"{kind_sql(f't_{name}', token(name))} AS k_{name}" for name in paths],
        *[f"coalesce(CASE WHEN {text} IS NOT NULL AND t_{name} NOT IN ({plain}) THEN {token(name)} END, "
          f"try_variant_get(v_{name}, '$', 'string')) AS s_{name}" for name in paths if name not in containers],
        *extra)


def kind_of_shape(shape: Column, token: Column) -> Column:
    """``kind_sql`` over columns."""
    return (
        F.when(shape.isNull(), "absent").when(shape == "STRING", "string").when(shape == "BIGINT", "integer")
        .when(shape == "VOID", "null").when(shape == "BOOLEAN", "boolean")
        .when(shape.startswith("OBJECT"), "object").when(shape.startswith("ARRAY"), "array")
        .when(token.rlike("^-?[0-9]+$"), "integer").otherwise("float")
    )


def json_type(value: Column, token: Column) -> Column:
    return kind_of_shape(F.schema_of_variant(value), token)


def nothing_there(kind: Column) -> Column:
    return kind.isin("absent", "null")


def inspect_text(text: Column) -> Column:
    """A string in double quotes with its special characters escaped."""
    escaped = F.regexp_replace(text, r'(["\\]|#(?=[{$@]))', r"\\$1")
    for raw, shown in (("\n", "\\\\n"), ("\t", "\\\\t"), ("\r", "\\\\r")):
        escaped = F.regexp_replace(escaped, raw, shown)
    return F.concat(F.lit('"'), escaped, F.lit('"'))


def describe(kind: Column, string: Column, token: Column) -> Column:
    """How a message names an unusable value."""
    return (
        F.when(nothing_there(kind), F.lit("absent"))
        .when(kind == "string", F.when(string == "", F.lit("empty"))
              .otherwise(inspect_text(truncate_text(string, 64))))
        .when(kind == "object", F.lit("a Hash"))
        .when(kind == "array", F.lit("a Array"))
        .otherwise(token)
    )


def class_name(kind: Column, token: Column) -> Column:
    chosen = F.when(kind == "boolean", token).otherwise(kind)
    return F.coalesce(*[F.when(chosen == key, F.lit(name)) for key, name in CLASS_NAMES.items()])
