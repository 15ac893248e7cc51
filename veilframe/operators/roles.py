"""Which column plays which part."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql.types import NumericType

#: Names of metric columns (fixed values: the data model's naming).
QUALITY_NAME = r"^(tp_|.*_rtt_|tcp_retrans_|http_)"
VOLUME_NAME = r"_GB_[a-z_]*sum$"


@dataclass(frozen=True)
class Roles:
    """Columns of a usage log. Metrics are found by name where they are not given."""

    subscriber: str = "msisdn"
    time: str = "time_start"
    place: str = "enb"
    region: str = "province"
    categories: tuple[str, ...] = ("radio_access_type", "application_category")
    identifiers: tuple[str, ...] = ("msisdn", "imsi", "imei", "tac")
    quality_name: str = QUALITY_NAME
    volume_name: str = VOLUME_NAME
    #: Name of the subscriber key inside the library; no release has it.
    key: str = field(default="_subscriber")

    def volumes(self, df: DataFrame) -> list[str]:
        return [c for c in df.columns if re.search(self.volume_name, c)]

    def qualities(self, df: DataFrame) -> list[str]:
        """Numeric columns of the quality pattern; a volume is never one."""
        numeric = {f.name for f in df.schema if isinstance(f.dataType, NumericType)}
        return [c for c in df.columns if re.match(self.quality_name, c) and not re.search(self.volume_name, c) and c in numeric]

    @property
    def cell(self) -> list[str]:
        return ["time_bucket", self.region, *self.categories]

    @property
    def slice(self) -> list[str]:
        return ["time_bucket", self.region]

    @property
    def quasi(self) -> list[str]:
        return ["time_bucket", "area", *self.categories]
