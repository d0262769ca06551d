"""Catalogs: which tables a user owns, what refers to what, who may write, and which entries a choice names."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SYSTEM_SCHEMAS = ("pg_catalog", "information_schema", "pg_toast")


def user_tables(relations: DataFrame, system: Sequence[str] = SYSTEM_SCHEMAS) -> DataFrame:
    """Relations that hold a user's rows: ordinary or partitioned, lasting, outside system schemas, owned by no extension."""
    return relations.filter(F.col("kind").isin("r", "p") & (F.col("persistence") != "t") & ~F.col("schema_name").isin(*system) & F.col("extension").isNull())


def chosen_schemas(tables: DataFrame, references: DataFrame, schemas: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Tables of the chosen schemas, and references of which both ends are left."""
    kept = tables.filter(F.col("schema_name").isin(*schemas)) if schemas else tables
    names = kept.select("schema_name", "table_name")
    inside = references
    for side in ("from", "to"):
        inside = inside.join(names.toDF(f"{side}_schema", f"{side}_table"), [f"{side}_schema", f"{side}_table"], "left_semi")
    return kept, inside


def hidden_rows(tables: DataFrame) -> DataFrame:
    """Tables of which a role does not see all rows: with row security that the role cannot pass by."""
    return tables.filter(F.col("row_security") & ~F.col("bypass") & (~F.col("owned") | F.col("forced")))


WRITES = ("ALL", "ALTER", "CREATE", "DELETE", "DROP", "INSERT", "TRUNCATE", "UPDATE")


def write_grants(grants: DataFrame, text: str = "grant") -> DataFrame:
    """Grants with `writes`: the sorted privileges among them that write."""
    listed = F.regexp_extract(F.upper(F.col(text)), r"^GRANT (.*?) ON ", 1)
    words = F.transform(F.split(listed, ","), lambda w: F.regexp_extract(F.trim(w), r"^(\w+)", 1))
    return grants.withColumn("writes", F.array_sort(F.array_intersect(F.array_distinct(words), F.array(*map(F.lit, WRITES)))))


def pick_tables(manifest: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted, problem: `missing` or `ambiguous` where a name stands for no or for several tables, else null.

    A wanted name is `table` or `schema.table`; it may be asked for once only, else it is `repeated`.
    """
    names = manifest.select(F.col("schema_name").alias("s"), F.col("table_name").alias("n"))
    asked = wanted.groupBy("wanted").agg(F.count(F.lit(1)).alias("times"))
    keys = names.select("n", F.explode(F.array(F.col("n"), F.concat_ws(".", "s", "n"))).alias("wanted")).groupBy("wanted").agg(F.count(F.lit(1)).alias("hits"))
    joined = asked.join(keys, "wanted", "left")
    problem = F.when(F.col("times") > 1, "repeated").when(F.col("hits").isNull(), "missing").when(F.col("hits") > 1, "ambiguous")
    return joined.select("wanted", problem.alias("problem"))


def overridden(local: DataFrame, recorded: DataFrame, key: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Local rows whose fields a recorded row of the same key replaces where it has a value."""
    other = recorded.select(*key, *[F.col(f).alias(f"_r_{f}") for f in fields])
    joined = local.join(other, list(key), "left")
    return joined.select(*[F.coalesce(f"_r_{c}", c).alias(c) if c in fields else F.col(c) for c in local.columns])


def same_object(a: str, b: str) -> Column:
    """Whether two structs of uri, size and modified are one object."""
    from functools import reduce

    return reduce(lambda x, y: x & y, [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in ("uri", "size", "modified")])


def paused(now: Column) -> Column:
    return F.coalesce(F.col("paused") & (F.col("paused_until").isNull() | (now < F.col("paused_until"))), F.lit(False))


#: What a drill's failure says when stored objects are damaged or missing.
DAMAGE = ("does not authenticate", "is missing", "shorter than its index", "is in no index", "not found", "No such object", "does not parse")


def damaged(name: Column, kind: Column, passed: Column, actual: Column, message: Column) -> Column:
    """Whether an assertion of a drill speaks of stored damage: one that failed, and names damage or is the one of the
    repository's integrity. Users' checks of commands and data, and a read that storage did not answer, do not."""
    said = F.concat(F.coalesce(actual, F.lit("")), F.lit(" "), F.coalesce(message, F.lit("")))
    marked = F.lit(False)
    for words in DAMAGE:
        marked |= F.contains(said, F.lit(words))
    spared = passed | F.coalesce(kind.isin("check", "data"), F.lit(False)) | (name == "RepositoryRead")
    return F.coalesce(~spared & ((name == "RepositoryIntegrity") | marked), F.lit(False))


def stored_damage(assertions: DataFrame, report: Sequence[str], place: str) -> DataFrame:
    """report, damage: what the first assertion that speaks of stored damage found, for each report that did not pass.

    assertions: report, `place`, status of the report, name, kind, passed, actual and message.
    """
    bad = damaged(*(F.col(c) for c in ("name", "kind", "passed", "actual", "message"))) & (F.col("status") != "passed")
    return assertions.filter(bad).groupBy(*report).agg(F.min_by(F.trim(F.coalesce("actual", F.lit(""))), place).alias("damage"))


#: The wording of findings about roles.
FINDINGS = {
    "super": "connects as {role}, a superuser; a read-only role is enough",
    "writes": "{role} can write to {n} table(s) ({names}){extra}; a read-only role is enough",
    "creates": "{role} writes to no table but can {extra}; a read-only role is enough",
    "hidden": "row-level security hides rows of {n} table(s) ({names}) from {role}",
}


def _worded(kind: str, **parts: Column) -> Column:
    pieces = re.split(r"\{(\w+)\}", FINDINGS[kind])
    return F.concat(*[parts[p] if k % 2 else F.lit(p) for k, p in enumerate(pieces)])


def role_findings(roles: DataFrame, tables: DataFrame) -> DataFrame:
    """role, kind, message of what a role can do beyond reading (`role`) and of rows it does not see (`row_security`).

    roles: role, super, create_role, create_db, bypass. tables: role, table_name, writes, hidden. A superuser is told
    before what it can write, that before what it can create; up to three tables are named. A superuser and a role that
    passes row security by see every row.
    """
    named = lambda flag: F.array_sort(F.collect_set(F.when(F.col(flag), F.col("table_name"))))
    facts = tables.groupBy("role").agg(named("writes").alias("writable"), named("hidden").alias("unseen"))
    none = F.array().cast("array<string>")
    rows = roles.join(facts, "role", "left").withColumns({c: F.coalesce(c, none) for c in ("writable", "unseen")})
    more = lambda c: F.when(F.size(c) > 3, F.concat(F.lit(" and "), (F.size(c) - 3).cast("string"), F.lit(" more"))).otherwise("")
    listed = lambda c: {"role": F.col("role"), "n": F.size(c).cast("string"), "names": F.concat(F.array_join(F.slice(c, 1, 3), ", "), more(c))}
    made = F.array_compact(F.array(F.when(F.col("create_role"), F.lit("create roles")), F.when(F.col("create_db"), F.lit("create databases"))))
    extra = F.array_join(made, " and ")
    message = (
        F.when(F.col("super"), _worded("super", role=F.col("role")))
        .when(F.size("writable") > 0, _worded("writes", **listed("writable"), extra=F.when(F.size(made) > 0, F.concat(F.lit(" and "), extra)).otherwise("")))
        .when(F.size(made) > 0, _worded("creates", role=F.col("role"), extra=extra))
    )
    hidden = F.when((F.size("unseen") > 0) & ~F.col("super") & ~F.col("bypass"), _worded("hidden", **listed("unseen")))
    found = F.array(F.struct(F.lit("role").alias("kind"), message.alias("message")), F.struct(F.lit("row_security").alias("kind"), hidden.alias("message")))
    return rows.select("role", F.explode(found).alias("f")).select("role", "f.kind", "f.message").filter("message IS NOT NULL")


def checksum_failures(lines: DataFrame, text: str = "line") -> DataFrame:
    """file, failures: of the failures counted line by line and the stated total of a file, the larger."""
    block = r'checksum.*in file "([^"]+)", block \d+'
    total = r'file "([^"]+)" has a total of (\d+) checksum'
    each = lines.filter(F.col(text).rlike(block)).groupBy(F.regexp_extract(text, block, 1).alias("file")).agg(F.count(F.lit(1)).alias("n"))
    stated = lines.filter(F.col(text).rlike(total)).groupBy(F.regexp_extract(text, total, 1).alias("file")).agg(F.max(F.regexp_extract(text, total, 2).cast("long")).alias("n"))
    return each.unionByName(stated).groupBy("file").agg(F.max("n").alias("failures"))


def needed_erasure_object(name: Column, oldest_backup: Column) -> Column:
    """Whether an object of erasures is needed: its newest erasure plus an hour is after the oldest backup. The name
    starts with twenty digits of nanoseconds; other names are never pruned."""
    nanos = F.regexp_extract(name, r"^(\d{20})-", 1)
    micros = F.substring(nanos, 1, 17).try_cast("long")
    return F.when(nanos == "", True).otherwise(micros + 3_600_000_000 > F.unix_micros(oldest_backup.cast("timestamp")))


def metrics(rows: DataFrame, name: str, label: str, value: str) -> DataFrame:
    """line: one gauge a row; a value that was never reached is left out, not 0."""
    shown = F.concat(F.lit(f"{name}{{{label}=\""), F.replace(F.col(label), F.lit('"'), F.lit('\\"')), F.lit('"} '), F.col(value).cast("string"))
    return rows.filter(F.col(value).isNotNull()).select(shown.alias("line"))


def validate_checks(checks: Sequence[dict], variables: Sequence[str] = ("taken_at",)) -> list[str]:
    """Problems of users' checks: no or repeated name, both or neither of sql and command, an expectation that does not
    read, an unknown or unclosed variable."""
    from tidemark.operators.verify import parse_expectation

    problems, seen = [], set()
    for c in checks:
        name = (c.get("name") or "").strip()
        if not name:
            problems.append("a check has no name")
            continue
        if name in seen:
            problems.append(f"{name}: the name is taken")
        seen.add(name)
        if bool(c.get("sql")) == bool(c.get("command")):
            problems.append(f"{name}: either sql or command")
        if c.get("sql") and not c.get("expect"):
            problems.append(f"{name}: sql without an expectation")
        if c.get("command") and c.get("expect"):
            problems.append(f"{name}: a command with an expectation")
        if c.get("expect"):
            try:
                parse_expectation(c["expect"])
            except ValueError as e:
                problems.append(f"{name}: {e}")
        body = c.get("sql") or ""
        used = re.findall(r"\{\{\s*(\w+)\s*\}\}", body)
        if body.count("{{") != len(used):
            problems.append(f"{name}: a variable is not closed")
        problems += [f"{name}: unknown variable {v}" for v in used if v not in variables]
    return problems


def substituted(sql: str, **values: str) -> str:
    """Variables replaced; an unknown one is an error."""

    def put(m: re.Match) -> str:
        if m[1] not in values:
            raise ValueError(f"unknown variable {m[1]}")
        return values[m[1]]

    return re.sub(r"\{\{\s*(\w+)\s*\}\}", put, sql)
