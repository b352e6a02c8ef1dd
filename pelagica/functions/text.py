"""Names, tokens and keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def tag_of_file(file_name: Column | str) -> Column:
    """Tag id at the head of a logger file name: ``<tag>_...`` or ``<tag>.csv``."""
    head = F.split_part(_col(file_name), F.lit("_"), F.lit(1))
    return F.split_part(head, F.lit("."), F.lit(1))


def uni_id(project: Column | str, bird: Column | str) -> Column:
    """Key of one animal in one project."""
    return F.concat_ws("_", _col(project), _col(bird))


def species_of(bird_id: Column | str) -> Column:
    """Species code at the head of a bird id."""
    return F.split_part(_col(bird_id), F.lit("_"), F.lit(1))


def file_token(tag: Column | str, moment: Column) -> Column:
    """``<tag>_GPRS_<yyyymmdd>``, the head of a transmitted file's name."""
    return F.concat(_col(tag).cast("string"), F.lit("_GPRS_"), F.date_format(moment, "yyyyMMdd"))
