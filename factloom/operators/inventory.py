"""Inventory of files: exclusion, classification, languages, technologies and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import extension, file_name, let

MAX_FILE_BYTES, SIGNAL_CHARS = 2 * 1024 * 1024, 512 * 1024

# Names that decide about a file.
EXCLUDED_DIRECTORIES = (".git", "node_modules", "bin", "obj", "target", "dist", "build", "coverage", ".knowledge", ".venv", "venv", "vendor")
BINARY_EXTENSIONS = (".dll", ".exe", ".class", ".jar", ".zip", ".png", ".jpg", ".jpeg", ".gif", ".pdf", ".pdb", ".so", ".dylib", ".woff", ".woff2")
LANGUAGES = {
    ".cs": "c_sharp", ".java": "java", ".ts": "typescript", ".tsx": "tsx", ".js": "javascript", ".jsx": "javascript", ".py": "python",
    ".xml": "xml", ".json": "json", ".yaml": "yaml", ".yml": "yaml", ".toml": "toml",
}
MANIFESTS = ("package.json", "angular.json", "pom.xml", "build.gradle", "build.gradle.kts", "pyproject.toml", "requirements.txt", "web.xml", "weblogic.xml", "application.xml")
CREDENTIALS = r"(?i)(^|/)(\.env|id_rsa|id_ed25519|.*\.(pfx|p12|pem|key))$"
# What gives a technology away, by a file's name or by its text in lower case (webflux: in the text as it is).
SIGNALS = (
    ("dotnet", r"\.csproj$", r"\bmicrosoft\.aspnetcore\b|\b(?:app|group)\.map(?:get|post|put|patch|delete)\s*\("),
    ("angular", r"(?:^|/)angular\.json$", r"[\"']@angular/core[\"']"),
    ("react", None, r"[\"'](?:react|react-dom)[\"']|\bfrom\s+[\"']react[\"']"),
    ("express", None, r"\bfrom\s+[\"']express[\"']|\brequire\s*\(\s*[\"']express[\"']"),
    ("spring", None, r"\borg\.springframework\b|\bspring-boot\b"),
    ("jee", r"(?:^|/)(?:web|weblogic|application)\.xml$", r"\b(?:jakarta|javax)\.(?:ws\.rs|ejb|jms)\b"),
)
WEBFLUX = r"\bspring-boot-starter-webflux\b|\bRouterFunction\s*<|\bRouterFunctions\.(?:route|nest)\s*\(|\bServerRequest\b|\bServerResponse\b"
EXPRESS_PACKAGE = r"[\"']express[\"']\s*:"
#: Technologies of manifests by name, and those of the signals that a manifest of the name can have.
MANIFEST_TECHNOLOGIES = (
    (r"(?:^|/)package\.json$", "nodejs", ("angular", "react", "express")), (r"(?:^|/)(?:pom\.xml|build\.gradle[^/]*)$", "java", ("spring", "webflux")), (r"(?:^|/)(?:pyproject\.toml|requirements\.txt)$", "python", ()),
    (r"\.csproj$", "dotnet", ()), (r"(?:^|/)(?:web|weblogic|application)\.xml$", "java-jee", ()),
)


def exclusion_reason(path: Column, kind: Column, size: Column, most: int = MAX_FILE_BYTES) -> Column:
    """Why a file isn't read; null if it is. The first reason counts."""
    inside = F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, EXCLUDED_DIRECTORIES)))
    return (
        F.when(inside, "excluded_directory").when(kind == "submodule", "submodule_not_authorized").when(kind == "symlink", "symlink")
        .when(size > most, "size_limit").when(extension(path).isin(*BINARY_EXTENSIONS), "binary").when(path.rlike(CREDENTIALS), "credential_file")
    )


def language(path: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair)), extension(path))


def is_manifest(path: Column) -> Column:
    return F.lower(file_name(path)).isin(*MANIFESTS) | path.rlike(r"(?i)\.(?:csproj|sln)$")


def classification(path: Column) -> Column:
    return (
        F.when(is_manifest(path) | path.rlike(r"(?i)(?:^|/)(appsettings[^/]*\.json)$"), "manifest")
        .when(path.rlike(r"(?i)(?:^|/)(test|tests|spec|specs)(?:/|$)|(?:\.|_)(?:test|spec)\.[^.]+$"), "test")
        .when(path.rlike(r"(?i)\.(?:md|adoc|rst)$"), "documentation").when(language(path).isNotNull(), "source").otherwise("other")
    )


def inventory(entries: DataFrame, most: int = MAX_FILE_BYTES) -> DataFrame:
    """entries (repository_id, relative_path, size, kind, source_hash; text null where it couldn't be read) with
    excluded_reason, classification, language and state."""
    path = F.col("relative_path")
    out = entries.withColumns({"excluded_reason": exclusion_reason(path, F.col("kind"), F.col("size"), most), "language": language(path)})
    state = (
        F.when(F.col("excluded_reason").isNotNull(), "excluded").when(F.col("language").isNull() & ~is_manifest(path), "unsupported")
        .when(F.col("text").isNull(), "failed").otherwise("processed")
    )
    kept = F.col("excluded_reason").isNull()
    return out.withColumns({"state": state, "classification": F.when(kept, classification(path)).otherwise("other"), "language": F.when(kept, F.col("language"))})


def coverage(files: DataFrame) -> DataFrame:
    """Counts for each repository; discovered = excluded + eligible, eligible = processed + failed + unsupported + not_scanned."""
    n = lambda state: F.count_if(F.col("state") == state)
    reasons = files.filter("excluded_reason is not null").groupBy("repository_id", "excluded_reason").count()
    histogram = reasons.groupBy("repository_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("excluded_reason", "count")))).alias("exclusion_reasons"))
    counts = files.groupBy("repository_id").agg(F.count(F.lit(1)).alias("discovered"), *(n(s).alias(s) for s in ("excluded", "processed", "failed", "unsupported")))
    full = counts.withColumn("eligible", F.col("discovered") - F.col("excluded")).withColumn("not_scanned", F.expr("eligible - processed - failed - unsupported"))
    return full.join(histogram, "repository_id", "left")


def technology_signals(files: DataFrame) -> DataFrame:
    """(repository_id, technology) that names and texts of files give away."""
    name, raw = F.lower("relative_path"), F.substring("text", 1, SIGNAL_CHARS)

    def found(head: Column) -> Column:
        told = [F.when((name.rlike(file) if file else F.lit(False)) | head.rlike(pattern), F.lit(t)) for t, file, pattern in SIGNALS]
        package = F.when(name.rlike(r"(?:^|/)package\.json$") & head.rlike(EXPRESS_PACKAGE), F.lit("express"))
        return F.array_compact(F.array(*told, package, F.when(raw.rlike(WEBFLUX), F.lit("webflux"))))

    return files.filter("text is not null and excluded_reason is null").select("repository_id", F.explode(let(F.lower(raw), found)).alias("technology")).distinct()


def technologies(files: DataFrame, signals: DataFrame) -> DataFrame:
    """(repository_id, relative_path, technology) of manifests: their own, and those of the repository's signals that they can have."""
    name = F.lower("relative_path")
    own = F.coalesce(*(F.when(name.rlike(p), F.struct(F.lit(t).alias("own"), F.array(*map(F.lit, more)).cast("array<string>").alias("more"))) for p, t, more in MANIFEST_TECHNOLOGIES))
    told = files.filter("excluded_reason is null").select("repository_id", "relative_path", own.alias("t")).filter("t is not null")
    some = told.select("repository_id", "relative_path", F.explode("t.more").alias("technology")).join(signals, ["repository_id", "technology"], "left_semi").select("repository_id", "relative_path", "technology")
    return told.select("repository_id", "relative_path", F.col("t.own").alias("technology")).unionByName(some)


def bundle_quality(capabilities: DataFrame) -> DataFrame:
    """capabilities (repository_id, status): partial if one isn't whole, unsupported if there is none."""
    whole = F.bool_and(F.col("status") == "implemented")
    return capabilities.groupBy("repository_id").agg(F.when(F.count("status") == 0, "unsupported").when(whole, "complete").otherwise("partial").alias("quality"))


def rule_counters(results: DataFrame) -> DataFrame:
    """results (capability, processed boolean, limitation): counts for each capability."""
    return results.groupBy("capability").agg(F.count_if("processed").alias("processed"), F.count_if(~F.col("processed")).alias("failed"), F.array_sort(F.collect_set("limitation")).alias("limitations"))
