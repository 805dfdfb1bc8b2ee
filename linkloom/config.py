"""Configuration of the linker: ``key = value`` lines to a plain value object; nothing distributed."""

from __future__ import annotations

from dataclasses import dataclass, field

LANGUAGES = ("en", "es", "zh")
TARGET_KBS = ("freebase", "enwiki")


@dataclass(frozen=True)
class Config:
    """Paths and switches; models are by language, languages without one have the default."""

    index_path: str = ""
    search_cache_path: str = ""
    target_kb: str = "freebase"
    use_search: bool = False
    rank_in_tagging: bool = True
    ner_configs: dict[str, str] = field(default_factory=dict)
    ranking_models: dict[str, str] = field(default_factory=dict)

    def ranking_model(self, lang: str) -> str:
        return self.ranking_models.get(lang, self.ranking_models.get("default", ""))


def parse_config(text: str, languages: tuple[str, ...] = LANGUAGES) -> Config:
    """Read a configuration; comments (#) and empty lines are skipped, an unknown key or target is an error."""
    values: dict = {}
    by_lang: dict[str, dict[str, str]] = {"ner_configs": {}, "ranking_models": {}}
    for number, raw in enumerate(text.splitlines(), 1):
        line = raw.split("#", 1)[0].strip()
        if not line:
            continue
        key, found, value = (part.strip() for part in line.partition("="))
        if not found:
            raise ValueError(f"line {number}: no value for {key!r}")
        for suffix, target in (("_ner_config", "ner_configs"), ("_ranking_model", "ranking_models")):
            if key.endswith(suffix):
                by_lang[target][key.removesuffix(suffix)] = value
                break
        else:
            if key not in Config.__dataclass_fields__ or key in by_lang:
                raise ValueError(f"line {number}: unknown key {key!r}")
            values[key] = value.lower() in ("true", "1", "yes") if key in ("use_search", "rank_in_tagging") else value
    if values.get("target_kb", "freebase") not in TARGET_KBS:
        raise ValueError(f"target_kb must be one of {TARGET_KBS}")
    for models in by_lang.values():
        for lang in languages if "default" in models else ():
            models.setdefault(lang, models["default"])
    return Config(**values, **by_lang)
