"""Names, limits, patterns and texts that results must match."""

# Item types in the order they are worked through.
TYPE_RANK = {"ops": 0, "schema": 1, "logic": 2, "permissions": 3, "reference": 4, "data": 5}

# How each item type is tracked.
RUN_ONCE = ("ops", "data")
RERUNNABLE = ("schema", "logic", "permissions")
LEDGER_TYPES = ("ops", "schema", "logic", "permissions", "data")

# Limits on what a report shows.
PLAN_ROW_LIMIT = 20
DUPLICATE_KEY_LIMIT = 5

# The namespace that always exists and that flat files belong to.
DEFAULT_NAMESPACE = "public"

# File name patterns.
VERSIONED_FILE = r"^(\d+(?:_\d+)*)__(.+)\.sql$"
PLAIN_FILE = r"^(.+)\.sql$"
FLAT_VERSIONED_FILE = r"^V(\d+(?:_\d+)*)__(.+)\.sql$"
FLAT_SCHEMA_FILE = r"^S__(.+)\.sql$"
FLAT_REPEATABLE_FILE = r"^R__(.+)\.sql$"

# Other names of types, by the name they are handled under.
TYPE_NAMES = {
    "int": ("integer", "int4", "serial", "serial4"),
    "bigint": ("int8", "bigserial", "serial8", "long"),
    "smallint": ("int2", "smallserial", "serial2", "short"),
    "tinyint": ("byte",),
    "float": ("real", "float4"),
    "double": ("double precision", "float8"),
    "decimal": ("numeric", "dec"),
    "boolean": ("bool",),
    "varchar": ("character varying",),
    "char": ("character", "bpchar"),
    "text": ("string",),
    "json": ("jsonb",),
    "binary": ("bytea",),
    "timestamp": ("timestamptz", "timestamp with time zone", "timestamp without time zone"),
}

# Types compared by something other than plain equality.
JSON_TYPE = "json"
TEXT_COMPARED_TYPES = ("xml", "point", "line", "lseg", "box", "path", "polygon", "circle")

# Referential actions through which a delete changes other tables.
REACHING_ACTIONS = ("CASCADE", "SET NULL", "SET DEFAULT")

# Refusal texts.
REFUSALS = {
    "no_table": "table {table} does not exist",
    "not_a_table": "{table} is not a table",
    "query_failed": "the query failed: {error}",
    "no_column": "column {column} does not exist on {table}",
    "generated": "column {column} is generated and cannot be declared",
    "identity": "column {column} is GENERATED ALWAYS AS IDENTITY, so it takes no declared value",
    "column_twice": "the query names column {column} twice",
    "no_primary_key": "{table} has no primary key; name the key columns with key=",
    "key_not_declared": "key column {column} is not one of the query's columns",
    "no_touch": "touch column {column} does not exist on {table}",
    "touch_declared": "touch column {column} is also one of the query's columns",
    "no_unique": "no unique index on {table} covers exactly the key ({key})",
    "live_duplicates": "the key ({key}) is not unique in {table}: {keys}",
    "null_key": "a row declares a NULL key {key}",
    "duplicate_key": "key ({key}) is declared more than once: {keys}",
    "reads_declared": "the query reads {source}, which {other} declares",
    "declared_twice": "{table} is already declared in {other}",
    "prune_reach": "prune would delete through foreign key {constraint} on {child} (ON DELETE {action})",
    "cycle": "reference tables reference each other in a cycle ({tables})",
    "too_long": "value too long for type {type}",
    "bad_value": "invalid input syntax for type {type}",
}

# The long names of types in refusal texts.
TYPE_LONG_NAMES = {
    "varchar": "character varying",
    "char": "character",
    "int": "integer",
    "decimal": "numeric",
    "double": "double precision",
}
