"""Settings of jobs: nine optional values, the later of two layers winning for each."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields
from urllib.parse import urlsplit

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfspark.functions import text as X
from shelfspark.plans.library import PROFILES


@dataclass(frozen=True)
class Settings:
    books: str | None = None
    imports: str | None = None
    kobo: str | None = None
    card: str | None = None
    reader: str | None = None
    reader_folder: str | None = None
    catalogue: str | None = None
    screen: str | None = None
    show_previews: bool | None = None

    def over(self, other: Settings) -> Settings:
        """These settings, and those of other where these say nothing."""
        return Settings(**{f.name: getattr(self, f.name) if getattr(self, f.name) is not None else getattr(other, f.name) for f in fields(self)})

    def checked(self) -> Settings:
        """The settings, if they can hold: absolute folders, a known screen, a catalogue and a reader that can be addressed."""
        for name in ("books", "imports", "kobo", "card", "reader_folder"):
            value = getattr(self, name)
            if value is not None and not value.startswith("/") and "://" not in value:
                raise ValueError(f"{name} is no absolute path: {value}")
        if self.screen is not None and profile(self.screen) is None:
            raise ValueError(f"no screen {self.screen}; there are {', '.join(PROFILES)}")
        if self.catalogue is not None and (urlsplit(self.catalogue).scheme not in ("http", "https") or not urlsplit(self.catalogue).netloc):
            raise ValueError(f"no address of a catalogue: {self.catalogue}")
        if self.reader is not None:
            address(self.reader)
        return self


def load(text: str | None) -> Settings:
    """From JSON; nothing gives none, and an unknown name is an error."""
    said = json.loads(text) if text and text.strip() else {}
    unknown = set(said) - {f.name for f in fields(Settings)}
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    return Settings(**said).checked()


def dump(settings: Settings) -> str:
    return json.dumps({k: v for k, v in asdict(settings).items() if v is not None}, indent=2)


def squashed(name: str) -> str:
    return "".join(c for c in name if c.isascii() and c.isalnum()).lower()


def profile(name: str) -> str | None:
    """The device that a name means."""
    return next((d for d, aliases in PROFILES.items() if squashed(name) in map(squashed, (d, *aliases))), None)


def address(text: str) -> tuple[str, int]:
    """Host and port of a reader on the network."""
    parts = urlsplit(text if "://" in text else f"http://{text}")
    if parts.scheme != "http" or not parts.hostname or parts.username or parts.query or parts.fragment or parts.path not in ("", "/"):
        raise ValueError(f"no address of a reader: {text}")
    return parts.hostname, parts.port or 80


NAMES = sorted(f.name for f in fields(Settings))
FOLDERS = ("books", "imports", "kobo", "card", "reader_folder")


def _fits(said: Column) -> Column:
    """Whether settings as a struct can hold."""
    known = [squashed(n) for d, aliases in PROFILES.items() for n in (d, *aliases)]
    rules = [
        *[said[n].startswith("/") | F.contains(said[n], F.lit("://")) for n in FOLDERS], X.squashed(said["screen"]).isin(known), said["catalogue"].rlike(r"(?i)^https?://[^/?#]+"),
        said["reader"].rlike(r"(?i)^(?:http://)?(?:[^/?#@:\[\]\s]+|\[[0-9a-f:.]+\])(?::[0-9]{1,5})?/?$"),
    ]
    out = F.lit(True)
    for rule in rules:
        out = out & F.coalesce(rule, F.lit(True))
    return out


def layered(over: Column, under: Column) -> Column:
    """As `load(over).over(load(under))` for columns of JSON: the settings as JSON by name, or null where a layer can't hold."""
    schema = ", ".join(f"{n} {'boolean' if n == 'show_previews' else 'string'}" for n in NAMES)
    layers, holds = [], F.lit(True)
    for text in (over, under):
        text = F.when(F.coalesce(X.trimmed(text), F.lit("")) == "", F.lit("{}")).otherwise(text)
        said = F.from_json(text, schema)
        names = F.json_object_keys(text)
        layers.append(said)
        holds = holds & names.isNotNull() & (F.size(F.array_except(names, F.array(*map(F.lit, NAMES)))) == 0) & _fits(said)
    return F.when(holds, F.to_json(F.struct(*[F.coalesce(layers[0][n], layers[1][n]).alias(n) for n in NAMES])))
