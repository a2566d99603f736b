"""Settings of a catalogue; the values are those that a server without settings of its own has."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Settings:
    expansion: int = 9
    top_level: int = 70
    ignored_zones: tuple[str, ...] = ()
    active_flags: tuple[str, ...] = ()
    show_locations: bool = True
    show_respawn: bool = True
    only_discovered: bool = False
    #: Rows a group and in all of placeholders; rows of an entity's locations; NPCs that a spawn point shows.
    placeholders_each: int = 25
    placeholders: int = 5000
    locations: int = 5000
    ground_spawns: int = 2000
    spawn_names: int = 8
    families: dict[str, int] = field(default_factory=lambda: {"spawns": 3000, "ground-spawns": 2000, "zone-points": 1000, "doors": 1000, "objects": 1000})

    def zones_left_out(self) -> list[str]:
        """Ignored zones without blanks, control characters, overlong names and repeats."""
        found = (z.strip() for z in self.ignored_zones if isinstance(z, str))
        return list(dict.fromkeys(z for z in found if z and len(z.encode()) <= 64 and all(32 <= ord(c) != 127 for c in z)))

    def flags(self) -> list[str]:
        found = (f.strip() for f in self.active_flags if isinstance(f, str))
        return list(dict.fromkeys(f for f in found if f and "," not in f))
