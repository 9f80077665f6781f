"""Settings of the linkage engine."""

from __future__ import annotations

from dataclasses import dataclass, field

# Words of addresses that never name a place.
STOPWORDS = (
    "FLAT", "PLOT", "DOOR", "ROOM", "FLOOR", "NO", "HNO", "DNO", "SNO", "NEAR", "OPP", "OPPOSITE", "BEHIND", "BESIDE", "ABOVE", "BELOW",
    "PIN", "PINCODE", "POST", "DIST", "DISTRICT", "MANDAL", "VILLAGE", "STATE", "INDIA", "TELANGANA", "ANDHRA", "PRADESH",
    "ROAD", "STREET", "LANE", "CROSS", "MAIN", "PHASE", "SECTOR", "BLOCK", "ENCLAVE", "COLONY", "APARTMENT", "APARTMENTS", "APTS",
    "RESIDENCY", "TOWERS", "TOWER", "HEIGHTS", "HOUSE", "BUILDING", "OLD", "NEW",
)

# What people write around a station's name.
NOISE = r"POLICE\s*STATION|P\.?\s*S\.?|THANA|CHOWKI"

# How surety is shown, and what a lookup was for.
SURETY = {"VERY HIGH": "Guaranteed", "HIGH": "Very Likely", "MEDIUM": "Likely", "LOW": "Possible", "NONE": "Unknown"}
LOOKUPS = {1: "DISTRICT", 2: "POLICE STATION", 3: "DISTRICT + POLICE STATION"}


@dataclass(frozen=True)
class LinkConfig:
    """Cutoffs hold from their value on; the tie width and the warning distance hold beyond it."""

    name_cutoff: float = 80.0
    locality_cutoff: float = 86.0
    top_n: int = 3
    min_letters: int = 4
    max_tie: int = 5
    warn_km: float = 30.0
    high_score: float = 95.0
    geocode_suffix: str = "Telangana, India"
    stopwords: tuple[str, ...] = field(default=STOPWORDS)
