"""Names, paths and labels as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkcurate import constants as K


def lit_strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def name_tokens(name: Column) -> Column:
    """Distinct lower-case ``[a-z0-9]`` runs of a name."""
    parts = F.split(F.lower(name), "[^a-z0-9]+")
    return F.array_distinct(F.filter(parts, lambda t: t != ""))


def infer_label(name: Column) -> Column:
    """``ignore`` > ``healthy`` > ``anomalous`` > null, by whole tokens."""
    tokens = name_tokens(name)

    def has(words):
        return F.arrays_overlap(tokens, lit_strings(words))

    return (
        F.when(has(K.IGNORE_WORDS), "ignore")
        .when(has(K.HEALTHY_WORDS), "healthy")
        .when(has(K.ANOMALOUS_WORDS), "anomalous")
    )


def path_parts(path: Column) -> Column:
    return F.split(path, "/")


def file_name(path: Column) -> Column:
    return F.element_at(path_parts(path), -1)


def file_stem(path: Column) -> Column:
    name = file_name(path)
    return F.when(F.instr(name, ".") > 1, F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)


def file_extension(path: Column) -> Column:
    """Lower-case last suffix with its dot, '' without one."""
    return F.lower(F.regexp_extract(file_name(path), r".(\.[^.]+)$", 1))


def has_extension(path: Column, extensions=K.IMAGE_EXTENSIONS) -> Column:
    return file_extension(path).isin(*extensions)


def inner_dirs(path: Column) -> Column:
    """Directories below the source directory: neither the first part nor the file name."""
    parts = path_parts(path)
    return F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0)))


def source_of(name: Column) -> Column:
    """Text before the first double underscore of a flattened name."""
    return F.when(F.instr(name, "__") > 0, F.substring_index(name, "__", 1)).otherwise(
        K.UNKNOWN_SOURCE
    )


def keep_list_label(folder: Column) -> Column:
    """Label of a kept crop folder, null when the folder is not kept."""
    label = F.when(F.lower(folder).endswith("___healthy"), "healthy").otherwise("anomalous")
    return F.when(folder.isin(*K.KEEP_FOLDERS), label)


def keep_list_name(folder: Column, path: Column) -> Column:
    return F.concat(F.lit("pv_"), F.substring(folder, 1, 30), F.lit("_"), file_name(path))


def consolidated_name(tag: Column, index: Column, path: Column) -> Column:
    """``tag_000123_a1b2c3.ext``: running index and six hex digits of the path's md5."""
    return F.concat(
        tag,
        F.format_string("_%06d_", index),
        F.substring(F.md5(path), 1, 6),
        file_extension(path),
    )


def seeded_hash(key: Column, seed: int = K.SPLIT_SEED) -> Column:
    """The order every 'random' choice uses: reproducible on any partitioning."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def hex_number(text: Column, start: int, digits: int) -> Column:
    return F.conv(F.substring(text, start, digits), 16, 10).cast("bigint")
