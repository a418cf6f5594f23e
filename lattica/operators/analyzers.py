"""Pattern analyzers over definitions: system calls, ioctl handlers, IPC services."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions.text import contains_like, like_ascii, suffixes_stripped

#: The names that the analyzers look for.
SYSCALL_PATTERNS = ("SYSCALL_DEFINE%", "__do_sys_%", "__se_sys_%", "sys_%")
SYSCALL_PREFIXES = ("__do_sys_", "__se_sys_", "sys_")
IOCTL_PATTERNS = ("%_ioctl", "%ioctl_handler%", "unlocked_ioctl%", "compat_ioctl%")
SERVICE_SUFFIXES = ("Stub", "Proxy", "Service", "Ability")
REGISTRATION_PATTERNS = ("%AddSystemAbility%", "%RegisterService%", "%Publish%")
TRACE_LIMIT = 100


def _any_like(value: Column, patterns: tuple[str, ...]) -> Column:
    found = like_ascii(value, patterns[0])
    for p in patterns[1:]:
        found = found | like_ascii(value, p)
    return found


def syscall_name(name: Column, qualified: Column) -> Column:
    """The macro's first argument, else the name without the first of the prefixes that it has, else the name."""
    macro = F.nullif(F.regexp_extract(qualified, r"(?U)SYSCALL_DEFINE\d\((\w+)", 1), F.lit(""))
    bare = name
    for p in reversed(SYSCALL_PREFIXES):
        bare = F.when(name.startswith(p), F.substring(name, len(p) + 1, 1 << 30)).otherwise(bare)
    return F.coalesce(macro, bare)


def syscalls(symbols: DataFrame) -> DataFrame:
    """name, number (digit of the macro, else 0), params, definition_file, definition_line; by raw name and id."""
    found = symbols.where("is_definition").where(_any_like(F.col("name"), SYSCALL_PATTERNS)).orderBy("name", "id")
    return found.select(
        syscall_name(F.col("name"), F.col("qualified_name")).alias("name"), F.coalesce(F.expr("try_cast(nullif(regexp_extract(name, 'SYSCALL_DEFINE([0-9])', 1), '') AS int)"), F.lit(0)).alias("number"),
        F.lit(None).cast("string").alias("params"), F.col("file_path").alias("definition_file"), F.col("line").alias("definition_line"),
    )


def ioctl_handlers(symbols: DataFrame) -> DataFrame:
    found = symbols.where("is_definition AND kind = 'function'").where(_any_like(F.col("name"), IOCTL_PATTERNS)).orderBy("file_path", "name", "id")
    empty = F.lit(None)
    return found.select(
        "name", empty.cast("string").alias("cmd_number"), empty.cast("string").alias("direction"), empty.cast("string").alias("type_char"),
        F.col("name").alias("function_handler"), F.col("file_path").alias("file"),
    )


def service_key(name: Column) -> Column:
    """The name without repetitions of the suffixes, in their order; the name itself if nothing is left."""
    return F.coalesce(F.nullif(suffixes_stripped(name, SERVICE_SUFFIXES), F.lit("")), name)


def ipc_services(symbols: DataFrame) -> DataFrame:
    """service_name, stub_class, proxy_class, message_codes: the last stub and proxy of each service by name and id."""
    found = symbols.where("is_definition AND kind = 'type'").where(
        _any_like(F.col("name"), ("%Stub%", "%Proxy%")) | contains_like(F.col("qualified_name"), "IRemoteBroker")
    )
    stub = F.col("name").contains("Stub")
    proxy = ~stub & F.col("name").contains("Proxy")
    last = F.struct("name", "id", "qualified_name")
    codes = F.array().cast("array<struct<code:int,name:string,handler_function:string>>")
    return found.groupBy(service_key(F.col("name")).alias("service_name")).agg(
        F.max(F.when(stub, last))["qualified_name"].alias("stub_class"), F.max(F.when(proxy, last))["qualified_name"].alias("proxy_class")
    ).withColumn("message_codes", codes)


def service_registrations(symbols: DataFrame) -> DataFrame:
    """Functions, defined here or not, whose name looks like a registration."""
    found = symbols.where("kind = 'function'").where(_any_like(F.col("name"), REGISTRATION_PATTERNS))
    return found.orderBy("file_path", "line", "id").select("name", "qualified_name")


def ipc_trace(symbols: DataFrame, service: str) -> DataFrame:
    """Definitions that mention the service, by kind and name; the report is limited to TRACE_LIMIT rows."""
    hit = contains_like(F.col("name"), service) | contains_like(F.col("qualified_name"), service)
    return symbols.where("is_definition").where(hit).orderBy("kind", "name", "id").limit(TRACE_LIMIT)
