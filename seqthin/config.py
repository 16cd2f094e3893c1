"""Parameters of a reduction run."""

from __future__ import annotations

from dataclasses import dataclass, replace

FREQUENCY_MODES = ("countmin", "exact")
SALT_FAMILIES = ("xorshift", "pcg64")


@dataclass(frozen=True)
class ReduceConfig:
    """Every tunable of the reduction; the defaults suit coronavirus-length genomes.

    ``frequency`` picks how "was this k-mer seen before?" is answered: by a
    Count-Min sketch (fixed memory, collisions hide some singletons) or by the
    exact set of k-mers seen.  ``kmer_cap`` limits the k-mer occurrences taken
    from one record; ``None`` reads whole sequences.
    """

    k: int = 15
    min_len: int = 27000
    max_n_frac: float = 0.05
    kmer_cap: int | None = None
    frequency: str = "countmin"
    cms_log2_width: int = 22
    warmup: int = 2000
    outlier_sd: float = 5.0
    err_rate: float = 1e-4
    cutoff_mass: float = 0.9
    sketch: int = 64
    threshold: float = 0.15
    bands: int = 16
    salts: str = "xorshift"
    by_month: bool = True
    shards: int = 1
    limit: int | None = None

    def __post_init__(self) -> None:
        if not 1 <= self.k <= 32:
            raise ValueError("k must be between 1 and 32")
        if self.sketch < 1 or self.bands < 1 or self.shards < 1:
            raise ValueError("sketch, bands and shards must be positive")
        if self.frequency not in FREQUENCY_MODES:
            raise ValueError(f"frequency must be one of {FREQUENCY_MODES}")
        if self.salts not in SALT_FAMILIES:
            raise ValueError(f"salts must be one of {SALT_FAMILIES}")

    def but(self, **changes) -> "ReduceConfig":
        return replace(self, **changes)


def archive() -> ReduceConfig:
    """Archive scale: collapse near-duplicates within about 0.5 % divergence."""
    return ReduceConfig()


def strict_quality() -> ReduceConfig:
    """Stricter completeness gate, one undivided comparison set."""
    return ReduceConfig(min_len=25000, max_n_frac=0.01, salts="pcg64", by_month=False)


def gene_scale() -> ReduceConfig:
    """Gene-length cohorts of one organism."""
    return ReduceConfig(threshold=0.005, sketch=256)
