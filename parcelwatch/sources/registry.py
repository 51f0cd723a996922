"""Registry documents and package manifests (JSON text) as tables.

A registry document holds every version of a package; it is parsed once, exploded to one row per
version and projected to typed columns.  Values keep their JSON type until they are checked, since
several fields may be text or an object.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls

_DOCUMENT = (
    "name string, `dist-tags` map<string,string>, time map<string,string>,"
    " maintainers array<struct<name: string, email: string>>, versions map<string,variant>"
)
_MAP, _PEOPLE = "map<string,variant>", "array<struct<name: string, email: string>>"


def _get(value: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(value, path, kind)


def _kind(value: Column, path: str) -> Column:
    return F.schema_of_variant(_get(value, path, "variant"))


def _text(value: Column, path: str) -> Column:
    """The field if it is JSON text, else null."""
    return F.when(_kind(value, path) == "STRING", _get(value, path))


def _or_empty(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def _repository(value: Column) -> Column:
    link = F.regexp_replace(
        F.regexp_replace(_or_empty(_text(value, "$.repository.url")), r"\Agit\+", ""),
        r"\.git\z",
        "",
    )
    return F.coalesce(_text(value, "$.repository"), link)


def _license(value: Column) -> Column:
    return _or_empty(F.coalesce(_text(value, "$.license"), _text(value, "$.license.type")))


def _has_scripts(value: Column) -> Column:
    return F.coalesce(_kind(value, "$.scripts").startswith("OBJECT"), F.lit(False))


def parse_documents(docs: DataFrame) -> DataFrame:
    """``docs(body)`` to ``name, latest, published, maintainers, versions``; bad JSON gives nulls."""
    doc = F.from_json("body", _DOCUMENT)
    return docs.select(doc.alias("doc")).select(
        F.col("doc.name").alias("name"),
        F.col("doc.`dist-tags`")["latest"].alias("latest"),
        F.col("doc.time").alias("published"),
        F.col("doc.maintainers").alias("maintainers"),
        F.col("doc.versions").alias("versions"),
    )


def package_versions(docs: DataFrame) -> DataFrame:
    """One row of metadata per published version."""
    exploded = parse_documents(docs).select(
        "name", "latest", "published", F.col("maintainers").alias("doc_maintainers"),
        F.explode("versions").alias("key", "m"),
    )
    m = F.col("m")
    provenance = _text(m, "$._npmUser.trustedPublisher.id")
    return exploded.select(
        F.coalesce(F.nullif(_text(m, "$.name"), F.lit("")), F.col("name")).alias("pkg"),
        F.coalesce(F.nullif(_text(m, "$.version"), F.lit("")), F.col("key")).alias("version"),
        (F.col("key") == F.col("latest")).alias("is_latest"),
        _or_empty(_text(m, "$.description")).alias("description"),
        _license(m).alias("license"),
        _or_empty(_text(m, "$._npmUser.name")).alias("publisher"),
        _or_empty(F.col("published")[F.col("key")]).alias("published_at"),
        _or_empty(_text(m, "$.dist.tarball")).alias("tarball_url"),
        _repository(m).alias("repository_url"),
        _or_empty(_text(m, "$.homepage")).alias("homepage"),
        F.coalesce(_get(m, "$.dist.fileCount", "bigint"), F.lit(0)).alias("file_count"),
        F.coalesce(_get(m, "$.dist.unpackedSize", "bigint"), F.lit(0)).alias("unpacked_size"),
        F.nullif(provenance, F.lit("")).alias("provenance_id"),
        F.coalesce(_get(m, "$.maintainers", _PEOPLE), F.col("doc_maintainers"),
                   F.array().cast(_PEOPLE)).alias("maintainers"),
        F.coalesce(~_kind(m, "$.bin").isin("VOID"), F.lit(False)).alias("is_cli"),
        _has_scripts(m).alias("has_scripts"),
        m.alias("manifest"),
    )


def manifest_versions(manifests: DataFrame) -> DataFrame:
    """``manifests(body)`` (a ``package.json`` each) in the layout of :func:`package_versions`."""
    m = F.col("m")
    author = F.coalesce(_text(m, "$.author"), _text(m, "$.author.name"))
    return (
        manifests.select(F.try_parse_json("body").alias("m"))
        .filter(m.isNotNull())
        .select(
            F.coalesce(F.nullif(_text(m, "$.name"), F.lit("")), F.lit("unknown")).alias("pkg"),
            F.coalesce(F.nullif(_text(m, "$.version"), F.lit("")), F.lit("0.0.0")).alias("version"),
            F.lit(True).alias("is_latest"),
            _or_empty(_text(m, "$.description")).alias("description"),
            _license(m).alias("license"),
            _or_empty(author).alias("publisher"),
            F.lit("").alias("published_at"),
            F.lit("").alias("tarball_url"),
            _repository(m).alias("repository_url"),
            _or_empty(_text(m, "$.homepage")).alias("homepage"),
            F.lit(0).cast("bigint").alias("file_count"),
            F.lit(0).cast("bigint").alias("unpacked_size"),
            F.lit(None).cast("string").alias("provenance_id"),
            F.coalesce(_get(m, "$.maintainers", _PEOPLE), F.array().cast(_PEOPLE)).alias(
                "maintainers"
            ),
            F.coalesce(~_kind(m, "$.bin").isin("VOID"), F.lit(False)).alias("is_cli"),
            _has_scripts(m).alias("has_scripts"),
            m.alias("manifest"),
        )
    )


def dependencies(versions: DataFrame) -> DataFrame:
    """``pkg, version, name, spec, kind``; a spec that is not text counts but is null."""

    def of(field: str, kind: str) -> DataFrame:
        entries = F.explode(_get(F.col("manifest"), f"$.{field}", _MAP)).alias("name", "_v")
        return versions.select("pkg", "version", entries).select(
            "pkg",
            "version",
            "name",
            F.when(F.schema_of_variant("_v") == "STRING", _get(F.col("_v"), "$")).alias("spec"),
            F.lit(kind).alias("kind"),
        )

    return of("dependencies", "direct").unionByName(of("optionalDependencies", "optional"))


def scripts(versions: DataFrame) -> DataFrame:
    """``pkg, version, name, command``; a command that is not text is null."""
    entries = F.explode(_get(F.col("manifest"), "$.scripts", _MAP)).alias("name", "_v")
    return versions.select("pkg", "version", entries).select(
        "pkg",
        "version",
        "name",
        F.when(F.schema_of_variant("_v") == "STRING", _get(F.col("_v"), "$")).alias("command"),
    )


def index_documents(docs: DataFrame) -> DataFrame:
    """What resolution needs of each document: its name, latest tag and version keys."""
    return parse_documents(docs).select(
        "name", "latest", F.map_keys("versions").alias("versions")
    )


def resolve_targets(targets: DataFrame, index: DataFrame) -> DataFrame:
    """Package specifiers ``targets(id, target)`` to exact versions, or the reason there is none.

    An explicit version must exist as written: tags and ranges are not resolved.
    """
    name, version = urls.split_specifier(F.col("target"))
    asked = targets.filter(~urls.is_local_archive(F.col("target"))).select(
        "id", name.alias("name"), F.nullif(version, F.lit("")).alias("wanted")
    )
    known = index.withColumn("_known", F.lit(True))
    chosen = F.coalesce(F.col("wanted"), F.nullif(F.col("latest"), F.lit("")))
    recent = F.array_join(
        F.slice("versions", F.greatest(F.size("versions") - 4, F.lit(1)), F.lit(5)), ", "
    )
    label = F.col("name")
    error = (
        F.when(F.col("_known").isNull(), F.concat(F.lit("Package not found: "), label))
        .when(
            chosen.isNull(),
            F.concat(F.lit("Cannot determine version for "), label,
                     F.lit(": no dist-tags.latest found")),
        )
        .when(
            F.col("versions").isNull(),
            F.concat(F.lit("No versions found in packument for "), label),
        )
        .when(
            ~F.array_contains("versions", chosen),
            F.concat(F.lit("Version "), chosen, F.lit(" not found for "), label,
                     F.lit(". Recent versions: "), recent),
        )
    )
    return (
        asked.join(known, "name", "left")
        .withColumn("error", error)
        .select("id", "name", F.when(F.col("error").isNull(), chosen).alias("version"), "error")
    )
