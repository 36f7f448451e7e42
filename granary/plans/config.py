"""Configuration of a retrieval pipeline, and the named variants of it."""

from __future__ import annotations

import json
import os
import re
from dataclasses import asdict, dataclass, field, fields, is_dataclass, replace
from functools import partial


# Names and defaults of all settings.


@dataclass(frozen=True)
class Chunking:
    prose_target_chars: int = 1500
    prose_min_chars: int = 100
    code_target_chars: int = 1500


@dataclass(frozen=True)
class Hierarchy:
    enabled: bool = True
    max_levels: int = 3
    min_nodes_for_level: int = 4
    soft_cluster_threshold: float = 0.1
    max_clusters: int = 50
    local_refine_min_nodes: int = 64
    target_dim: int = 10
    retrieval_mode: str = "tree_traversal"
    retrieval_token_budget: int = 2000
    traversal_top_k: int = 7
    cross_doc: bool = True
    cluster_covariance: str = "full"


@dataclass(frozen=True)
class Router:
    enabled: bool = True
    variant: str = "egr"
    egr_k: int = 20
    egr_temperature: float = 1.0
    egr_tau_low: float = 1.8
    egr_tau_high: float = 2.6
    comp_pca_dims: int = 8
    comp_alpha: float = 1.0
    comp_folds: int = 5


@dataclass(frozen=True)
class Fusion:
    variant: str = "rrf"
    rrf_k: int = 60
    hyde_expansion: str = "none"
    modality_kinds: tuple[str, ...] = ("prose", "code", "table")


@dataclass(frozen=True)
class Rerank:
    enabled: bool = True
    over_fetch: int = 3


@dataclass(frozen=True)
class Correction:
    enabled: bool = True
    variant: str = "sscc"
    crag_upper: float = 60.0
    crag_lower: float = 25.0
    sscc_tau_bi: float = 0.5
    sscc_tau_cross: float = 0.0
    enable_query_rewrite: bool = True


@dataclass(frozen=True)
class Graph:
    enabled: bool = False
    edges: tuple[str, ...] = ("sequential", "semantic", "xref", "ast")
    semantic_threshold: float = 0.7
    semantic_max_degree: int = 16
    gnn_layers: int = 2
    query_fusion: str = "project_query"
    late_fusion_beta: float = 0.5
    ppr_expand: bool = True
    ppr_min_score: float = 0.0
    ppr_steps: int = 20
    ppr_alpha: float = 0.15
    nli_cos_gate: float = 0.5


@dataclass(frozen=True)
class Prefetch:
    enabled: bool = False
    hit_cosine_threshold: float = 0.8


@dataclass(frozen=True)
class Repairs:
    enabled: bool = False
    split_precision_threshold: float = 0.4
    merge_coretrieval_threshold: float = 0.2


@dataclass(frozen=True)
class Expansion:
    enabled: bool = True
    window_chars: int = 200


@dataclass(frozen=True)
class Pipeline:
    seed: int = 42
    top_k: int = 5
    metric: str = "l2"
    chunking: Chunking = field(default_factory=Chunking)
    raptor: Hierarchy = field(default_factory=Hierarchy)
    router: Router = field(default_factory=Router)
    fusion: Fusion = field(default_factory=Fusion)
    rerank: Rerank = field(default_factory=Rerank)
    correction: Correction = field(default_factory=Correction)
    graph: Graph = field(default_factory=Graph)
    prefetch: Prefetch = field(default_factory=Prefetch)
    raac: Repairs = field(default_factory=Repairs)
    expansion: Expansion = field(default_factory=Expansion)


def with_values(cfg: Pipeline, values: dict[str, object]) -> Pipeline:
    """A copy with values at dotted paths, one added to a tuple at a path that ends in ``+``, one taken out at ``-``; unknown names raise."""
    for path, value in values.items():
        section, _, name = path.rstrip("+-").rpartition(".")
        held = getattr(cfg, section) if section else cfg
        if path[-1] in "+-":
            others = tuple(x for x in getattr(held, name) if x != value)
            value = getattr(held, name) if path[-1] == "+" and len(others) < len(getattr(held, name)) else (*others, value) if path[-1] == "+" else others
        changed = replace(held, **{name: value})
        cfg = replace(cfg, **{section: changed}) if section else changed
    return cfg


# The named variants and what each sets. A path ends in ``+`` where a value is added to a tuple, in ``-`` where it is
# taken out of it. FULL comes before every other variant; semantic_only sets what baseline does, too.
FULL: dict[str, object] = {
    "router.variant": "egr", "fusion.variant": "rrf", "fusion.hyde_expansion": "modality", "correction.variant": "sscc", "graph.enabled": True, "graph.edges+": "nli",
    "raptor.enabled": True, "raptor.cross_doc": True, "prefetch.enabled": True, "raac.enabled": True,
}
_PLAIN: dict[str, object] = {"router.variant": "keyword", "fusion.variant": "merge_dedup", "graph.enabled": False, "prefetch.enabled": False, "raac.enabled": False}
ABLATIONS: dict[str, dict[str, object]] = {
    "full": FULL,
    "baseline": _PLAIN | {"correction.variant": "crag"},
    "semantic_only": _PLAIN | {"router.enabled": False, "rerank.enabled": False, "correction.enabled": False, "raptor.enabled": False},
    "router_keyword": {"router.variant": "keyword"},
    "router_oracle": {"router.variant": "oracle"},
    "router_learned": {"router.variant": "learned"},
    "wo_dphf": {"fusion.variant": "single"},
    "wo_hyde": {"router.enabled": False},
    "wo_modality_hyde": {"fusion.hyde_expansion": "none"},
    "hyde_multi_prose": {"fusion.hyde_expansion": "multi_prose"},
    "wo_sscc": {"correction.variant": "crag"},
    "wo_crag": {"correction.enabled": False},
    "wo_rerank": {"rerank.enabled": False},
    "wo_graph": {"graph.enabled": False},
    "wo_graphsage": {"graph.gnn_layers": 0},
    "graph_no_expand": {"graph.ppr_expand": False},
    "wo_nli_edges": {"graph.edges-": "nli"},
    "wo_semantic_edges": {"graph.edges-": "semantic"},
    "wo_ast_edges": {"graph.edges-": "ast"},
    "wo_raptor": {"raptor.enabled": False},
    "wo_cross_doc": {"raptor.cross_doc": False},
    "raptor_kmeans": {"raptor.cluster_covariance": "spherical"},
    "wo_srp": {"prefetch.enabled": False},
    "wo_raac": {"raac.enabled": False},
}


def apply(name: str, base: Pipeline | None = None, reapply_full: bool = True) -> Pipeline:
    """A named variant of a base; FULL goes first unless told otherwise, which undoes what the base switched off."""
    if name not in ABLATIONS:
        raise KeyError(f"no variant named {name!r}")
    cfg = base or Pipeline()
    for values in (FULL, ABLATIONS[name]) if reapply_full else (ABLATIONS[name],):
        cfg = with_values(cfg, values)
    return cfg


#: Two variants on top of a base alone.
baseline, semantic_only = (partial(lambda name, cfg: apply(name, cfg, reapply_full=False), name) for name in ("baseline", "semantic_only"))


def dumps(cfg: Pipeline) -> str:
    return json.dumps(asdict(cfg), indent=2, sort_keys=True)


def loads(text: str) -> Pipeline:
    """A configuration from JSON; ${NAME} is the environment's value, empty where unset. Unknown names raise."""
    filled = re.sub(r"\$\{(\w+)\}", lambda m: json.dumps(os.environ.get(m[1], ""))[1:-1], text)

    def build(kind: type, values: dict) -> object:
        known = {f.name: f for f in fields(kind)}
        if extra := set(values) - set(known):
            raise ValueError(f"unknown settings {sorted(extra)}")
        made = {}
        for name, value in values.items():
            default = getattr(kind(), name)
            made[name] = build(type(default), value) if is_dataclass(default) else tuple(value) if isinstance(default, tuple) else value
        return kind(**made)

    return build(Pipeline, json.loads(filled))
