"""Column functions on catalog paths."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from sheafwork.functions.binding import bind

ROOT = ""


def _components(path: Column) -> Column:
    """Path components without empty and ``.`` ones."""
    return F.filter(F.split(path, "/"), lambda c: ~c.isin("", "."))


def display_path(path: Column, root: Column) -> Column:
    """``path`` relative to ``root``; the full path where it is not below ``root``."""
    prefix = F.concat(F.rtrim(root, F.lit("/")), F.lit("/"))
    return F.when(
        F.startswith(path, prefix), path.substr(F.length(prefix) + 1, F.length(path))
    ).otherwise(path)


def canonical_key(path: Column) -> Column:
    """One spelling per file: no ``.`` component, doubled slash or trailing slash.

    Only the spelling is looked at.  Where two paths name one file for another reason, give
    ``table_catalog`` a key column of your own, or use ``with_aliases``.
    """
    leading = F.when(F.startswith(path, F.lit("/")), F.lit("/")).otherwise(F.lit(""))
    return F.concat(leading, F.array_join(_components(path), "/"))


def url_path(url: Column) -> Column:
    """A URL without scheme, query and fragment, usable as a catalog path."""
    return F.regexp_extract(url, r"^(?:[a-z][a-z0-9+.-]*://)?([^?#]*)", 1)


def url_key(path: Column) -> Column:
    """``canonical_key`` for ``url_path``: mobile and ``www`` hosts count as the bare host."""
    return canonical_key(F.regexp_replace(path, r"^(?:www|m)[.]", ""))


def file_extension(path: Column) -> Column:
    """Text after the last dot of the file name; empty without one or if it only leads the name."""
    name = F.substring_index(F.rtrim(path, F.lit("/")), "/", -1)
    return F.when(
        F.contains(name.substr(F.lit(2), F.length(name)), F.lit(".")),
        F.substring_index(name, ".", -1),
    ).otherwise(F.lit(""))


def path_order(path: Column) -> Column:
    """Sort key that orders paths component by component.

    Plain string order would put ``a-b/x`` before ``a/x``, because ``-`` sorts before ``/``.
    """
    return F.replace(path, F.lit("/"), F.lit("\x00"))


def ancestors(path: Column) -> Column:
    """All directories above ``path``, the root (empty string) first."""
    return bind(
        F.split(path, "/"),
        lambda parts: F.transform(
            F.sequence(F.lit(0), F.size(parts) - 1),
            lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"),
        ),
    )


def lookup_path(value: Column) -> Column:
    """The catalog path an input names, or NULL if it leaves the catalog.

    ``""`` and ``.`` are the root.  A catalog has one root, so absolute inputs and inputs with a
    ``..`` component name nothing in it.
    """
    outside = F.startswith(value, F.lit("/")) | F.array_contains(F.split(value, "/"), "..")
    return F.when(~outside, F.array_join(_components(value), "/"))


def names_directory(value: Column) -> Column:
    """True for spellings that can only be a directory: ``""``, ``.``, ``a/`` and ``a/.``."""
    return value.isin("", ".") | F.endswith(value, F.lit("/")) | F.endswith(value, F.lit("/."))


def path_tried(value: Column, root: str = ROOT) -> Column:
    """Where an input was looked for: below ``root``, or where it points if absolute."""
    if root == ROOT:
        return value
    below = F.concat(F.lit(root.rstrip("/") + "/"), value)
    return F.when(F.startswith(value, F.lit("/")), value).otherwise(below)
