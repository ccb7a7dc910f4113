"""Configuration trees and named profiles."""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Any


@dataclass(frozen=True)
class Profile:
    denoiser: str = "deepfilternet3"
    strength: float = 4.0
    separate: bool = True
    weights: tuple[float, float, float] = (0.4, 0.35, 0.25)
    z_threshold: float = -0.22
    threshold: float = 0.32
    threshold_separated: float = 0.40
    jump_cap: float = 0.25
    trigger_min: float = 0.0
    kws_trigger: float = 0.5
    single_ratio: float = 0.15
    early_stop: bool = True
    energy_gate: bool = True
    english_gate: bool = True
    quick_first: bool = True
    #: Seconds that a row has in the separator, and in each other model; None: no limit, no child process.
    separator_seconds: float | None = 60.0
    model_seconds: float | None = None


_TUNED = Profile("renoise", 0.8, True, (0.4, 0.4, 0.2), -0.17, 0.28, 0.2805, 0.0625)

# The parameter sets by name.
PROFILES = {
    "default": Profile(),
    "verify_dual_full": Profile(),
    "verify_dual_finetune": _TUNED,
    "verify_dual_ft_w45": replace(_TUNED, weights=(0.45, 0.45, 0.1)),
    "verify_camplus_v7": _TUNED,
    "train_data_renoise": _TUNED,
    "renoise_optimal": replace(_TUNED, separate=False),
    "df3_nosep": replace(_TUNED, denoiser="deepfilternet3", strength=4.0, separate=False),
}


class Config:
    """A nested tree from YAML (repeated keys are an error) with dotted access; ``get`` falls back to a default."""

    def __init__(self, tree: dict | str | None = None):
        self.tree = load_yaml(tree) if isinstance(tree, str) else dict(tree or {})

    def get(self, path: str, default: Any = None) -> Any:
        at: Any = self.tree
        for key in path.split("."):
            if not isinstance(at, dict) or key not in at:
                return default
            at = at[key]
        return at

    def section(self, name: str) -> Config:
        return Config(self.get(name) or {})

    def profile(self, base: str = "default", **changes: Any) -> Profile:
        """A named profile with the tree's own settings and explicit changes (the command line's) on top."""
        own = {
            "denoiser": self.get("denoise.model"), "separate": self.get("separation.enable"), "z_threshold": self.get("voiceprint.ensemble.z_threshold"),
            "threshold": self.get("voiceprint.threshold"), "threshold_separated": self.get("separation.vp_threshold_separated"), "jump_cap": self.get("separation.sim_jump_cap"),
            "trigger_min": self.get("separation.sep_trigger_min"), "kws_trigger": self.get("separation.kws_trigger_sim"), "single_ratio": self.get("separation.kws_sep_energy_th"),
            "weights": tuple(w) if (w := self.get("voiceprint.ensemble.weights")) else None,
        }
        return replace(PROFILES[base], **{k: v for k, v in (own | changes).items() if v is not None})


def load_yaml(path: str) -> dict:
    import yaml

    class Strict(yaml.SafeLoader):
        pass

    def mapping(loader, node, deep=False):
        seen = set()
        for key, _ in node.value:
            name = loader.construct_object(key, deep=deep)
            if name in seen:
                raise ValueError(f"repeated key {name!r}, line {key.start_mark.line + 1}")
            seen.add(name)
        return yaml.SafeLoader.construct_mapping(loader, node, deep)

    Strict.add_constructor(yaml.resolver.BaseResolver.DEFAULT_MAPPING_TAG, mapping)
    with open(path, encoding="utf-8") as f:
        return yaml.load(f, Strict) or {}
