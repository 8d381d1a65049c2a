"""Settings as ``key=value`` lines, kept within their bounds."""

from __future__ import annotations

from dataclasses import dataclass, fields


@dataclass
class Settings:
    AutoCorrectEnabled: bool = False
    GrammarCheckEnabled: bool = True
    PredictionsEnabled: bool = False
    MaxPredictions: int = 3
    MinPredictionLength: int = 2
    AutoLearn: bool = True
    LanguageModelEnabled: bool = True
    PreferredScript: str = "Auto"
    PredictionSensitivity: float = 0.5
    MaxSpellingSuggestions: int = 5

    def bounded(self) -> Settings:
        self.PreferredScript = self.PreferredScript if self.PreferredScript in ("Auto", "Cyrillic", "Latin") else "Auto"
        self.PredictionSensitivity = min(1.0, max(0.0, self.PredictionSensitivity))
        self.MaxPredictions, self.MinPredictionLength, self.MaxSpellingSuggestions = (min(10, max(1, x)) for x in (self.MaxPredictions, self.MinPredictionLength, self.MaxSpellingSuggestions))
        return self


def loads(text: str) -> Settings:
    """Unknown keys and values that aren't of their key's kind are passed over."""
    out, kinds = Settings(), {f.name: type(f.default) for f in fields(Settings)}
    for line in text.splitlines():
        key, mark, value = line.partition("=")
        kind = kinds.get(key.strip())
        if not mark or kind is None:
            continue
        try:
            setattr(out, key.strip(), value.strip().lower() == "true" if kind is bool else kind(value.strip()))
        except ValueError:
            continue
    return out.bounded()


def dumps(settings: Settings) -> str:
    return "".join(f"{f.name}={getattr(settings, f.name)}\n" for f in fields(Settings))
