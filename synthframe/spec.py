"""Entity specifications: the schema contract of one table."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T


@dataclass(frozen=True)
class ForeignKey:
    """``column`` holds the id of ``entity`` in ``domain``."""

    column: str
    entity: str
    domain: str | None = None


@dataclass(frozen=True)
class EntitySpec:
    """One entity = one table. Key and foreign key columns are never generated or profiled."""

    domain: str
    entity: str
    schema: T.StructType
    key: str
    natural_key: str | None = None
    id_strategy: str = "auto"  # auto | deterministic | db_generated
    foreign_keys: tuple[ForeignKey, ...] = ()
    enums: dict[str, tuple[str, ...]] = field(default_factory=dict)
    kinds: dict[str, str] = field(default_factory=dict)  # guid, time or byte, where the Spark type is wider
    unique_guid_key: bool = True

    @property
    def deterministic(self) -> bool:
        """``auto`` means deterministic for a single client-settable string key."""
        if self.id_strategy != "auto":
            return self.id_strategy == "deterministic"
        return self.unique_guid_key and isinstance(self.schema[self.key].dataType, T.StringType)

    @property
    def skipped(self) -> frozenset[str]:
        return frozenset({self.key, *(fk.column for fk in self.foreign_keys)})

    @property
    def generated_fields(self) -> list[T.StructField]:
        return [f for f in self.schema.fields if f.name not in self.skipped]

    def conversion_target(self, name: str) -> str:
        """What raw text of a property is converted to."""
        if name in self.enums:
            return "enum"
        data_type = self.schema[name].dataType
        if isinstance(data_type, T.DayTimeIntervalType):
            return "timespan"
        if isinstance(data_type, T.TimestampNTZType):
            return "timestamp"
        return self.kinds.get(name, data_type.simpleString())

    def foreign_key_for(self, entity: str, domain: str | None = None) -> str | None:
        """Declared foreign key column, else ``{Entity}Id`` by name, else none."""
        for fk in self.foreign_keys:
            if fk.entity.lower() == entity.lower() and domain in (None, fk.domain):
                return fk.column
        wanted = f"{entity}id".lower()
        for f in self.schema.fields:
            if f.name.lower().replace("_", "") == wanted:
                return f.name
        return None

    def find_property(self, name: str) -> str | None:
        """Case-, space-, underscore- and hyphen-tolerant property lookup."""
        wanted = normalize(name)
        return next((f.name for f in self.schema.fields if normalize(f.name) == wanted), None)


def normalize(name: str) -> str:
    return name.translate(str.maketrans("", "", " _-")).lower()
