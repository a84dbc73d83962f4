"""Settings of a pipeline as plain dataclasses, with presets."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, fields, is_dataclass
from datetime import date


@dataclass
class SplitConfig:
    train: tuple[str, str] = ("2019-01-01", "2022-12-31")
    validation: tuple[str, str] = ("2023-01-01", "2023-12-31")
    test: tuple[str, str] = ("2024-01-01", "2024-12-31")
    min_days: int = 30
    max_overlap_days: int = 30

    def validate(self) -> list[str]:
        day = date.fromisoformat
        out = []
        parts = {k: (day(a), day(b)) for k, (a, b) in (("train", self.train), ("validation", self.validation), ("test", self.test))}
        for k, (a, b) in parts.items():
            if a >= b:
                out.append(f"{k} ends before it starts")
            elif (b - a).days < self.min_days:
                out.append(f"{k} is shorter than {self.min_days} days")
        for one, two in (("train", "validation"), ("validation", "test")):
            if (parts[one][1] - parts[two][0]).days > self.max_overlap_days:
                out.append(f"{one} overlaps {two} by more than {self.max_overlap_days} days")
        return out


@dataclass
class QualityConfig:
    max_missing_pct: float = 5.0
    max_consecutive_missing: int = 24
    min_demand_mw: float = 0.0
    max_demand_mw: float = 100_000.0

    def validate(self) -> list[str]:
        return [] if self.min_demand_mw < self.max_demand_mw else ["the demand range is empty"]


@dataclass
class StorageConfig:
    base: str = "data"
    compression: str = "zstd"
    partition_by: list[str] = field(default_factory=lambda: ["year"])
    name: str = "{dataset}_{region}_{year}"

    def path(self, dataset: str, region: str, year: int, stage: str = "processed") -> str:
        return f"{self.base}/{stage}/{self.name.format(dataset=dataset, region=region, year=year)}"


@dataclass
class PipelineConfig:
    regions: list[str] = field(default_factory=lambda: ["PACW", "ERCO", "NE", "CAL"])
    data_types: list[str] = field(default_factory=lambda: ["demand", "generation"])
    batch_days: int = 45
    max_parallel_steps: int = 4
    split: SplitConfig = field(default_factory=SplitConfig)
    quality: QualityConfig = field(default_factory=QualityConfig)
    storage: StorageConfig = field(default_factory=StorageConfig)

    def validate(self) -> list[str]:
        out = [] if self.regions else ["no regions"]
        out += [] if 1 <= self.batch_days <= 365 else ["batch_days must lie between 1 and 365"]
        out += [f"unknown data type {t}" for t in self.data_types if t not in ("demand", "generation")]
        return out + self.split.validate() + self.quality.validate()

    def to_dict(self) -> dict:
        return asdict(self)

    @classmethod
    def from_dict(cls, values: dict) -> PipelineConfig:
        return _build(cls, values)


def _build(kind, values: dict):
    names = {f.name: f for f in fields(kind)}
    if unknown := set(values) - set(names):
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    default = kind()
    out = {}
    for k, v in values.items():
        now = getattr(default, k)
        out[k] = _build(type(now), v) if is_dataclass(now) and isinstance(v, dict) else tuple(v) if isinstance(now, tuple) else v
    return kind(**out)


def development() -> PipelineConfig:
    return PipelineConfig(regions=["PACW"], batch_days=7, max_parallel_steps=2)


def production() -> PipelineConfig:
    return PipelineConfig(max_parallel_steps=8)


def research() -> PipelineConfig:
    return PipelineConfig(quality=QualityConfig(max_missing_pct=10.0))
