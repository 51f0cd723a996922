"""URL, repository and package-specifier expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import rules
from . import text as tx

_SCHEME = r"\A[a-zA-Z][a-zA-Z0-9+.-]*://"


def host(url: Column) -> Column:
    """Lower-case host without user info and port; empty if there is none."""
    return F.lower(F.regexp_extract(url, _SCHEME + r"(?:[^/?#\\]*@)?([^/:?#\\]+)", 1))


def is_ignored_host(name: Column) -> Column:
    """Whether the host is one of the well-known domains or below one."""
    # No listed domain has more labels than this, so its trailing labels decide.
    depth = max(d.count(".") + 1 for d in rules.IGNORED_DOMAINS)
    return tx.any_of(
        [
            F.substring_index(name, ".", -labels).isin(
                *[d for d in rules.IGNORED_DOMAINS if d.count(".") + 1 == labels]
            )
            for labels in range(1, depth + 1)
        ]
    )


def defang_ip(ip: Column) -> Column:
    return F.replace(ip, F.lit("."), F.lit("[.]"))


def defang_url(url: Column) -> Column:
    """``https://a.b/c.d`` -> ``hxxps[://]a[.]b/c.d``: scheme masked, dots masked in the host."""
    scheme = F.lower(F.regexp_extract(url, r"\A([a-zA-Z]+)://", 1))
    safe = F.when(scheme == "https", "hxxps").when(scheme == "http", "hxxp").otherwise("fxp")
    rest = F.regexp_extract(url, r"(?s)\A[a-zA-Z]+://(.*)\z", 1)
    domain = F.substring_index(rest, "/", 1)
    path = F.substr(rest, F.length(domain) + 1)
    return F.concat(safe, F.lit("[://]"), defang_ip(domain), path)


def github_repository(url: Column) -> tuple[Column, Column]:
    """Owner and repository of a GitHub link in any of its spellings; nulls for other links."""
    plain = F.regexp_replace(tx.js_trim(url), r"/+\z", "")
    short = r"(?s)\Agithub:([^/]*)/([^/]*)"
    full = F.regexp_replace(F.regexp_replace(plain, r"\Agit\+", ""), r"\Agit://", "https://")
    link = (
        r"\A[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#\\]*@)?(?i:github\.com)(?::[0-9]*)?"
        r"[/\\]+([^/?#\\]+)[/\\]+([^/?#\\]+)"
    )

    def part(group: int) -> Column:
        return F.when(
            plain.startswith("github:"),
            F.when(plain.rlike(short), F.regexp_extract(plain, short, group)),
        ).when(full.rlike(link), F.regexp_extract(full, link, group))

    return part(1), F.regexp_replace(part(2), r"\.git\z", "")


def split_specifier(spec: Column) -> tuple[Column, Column]:
    """``@s/n@1`` -> ``@s/n``, ``1``; the version is null when there is no version mark."""
    scoped, plain = r"(?s)\A(@.*)@([^@]*)\z", r"(?s)\A([^@]*)@(.*)\z"
    is_scoped = spec.startswith("@")
    name = (
        F.when(is_scoped & spec.rlike(scoped), F.regexp_extract(spec, scoped, 1))
        .when(~is_scoped & spec.rlike(plain), F.regexp_extract(spec, plain, 1))
        .otherwise(spec)
    )
    version = F.when(is_scoped & spec.rlike(scoped), F.regexp_extract(spec, scoped, 2)).when(
        ~is_scoped & spec.rlike(plain), F.regexp_extract(spec, plain, 2)
    )
    return name, version


def is_local_archive(spec: Column) -> Column:
    return spec.rlike(r"\A(?:\./|/|\.\./)|\.tgz\z|\.tar\.gz\z")


def is_pinned(spec: Column) -> Column:
    """Whether a specifier carries a version or range rather than nothing or a moving tag."""
    _, version = split_specifier(spec)
    return F.coalesce(~version.isin(*rules.FLOATING_TAGS), F.lit(False))


def bare_name(name: Column) -> Column:
    """Package name without scope, lower-case."""
    return F.lower(F.regexp_replace(name, r"\A@[^/]+/", ""))
