"""The vocabulary that keyword extraction works with; every list is a parameter."""

from __future__ import annotations

from dataclasses import dataclass, field


def _set(words: str) -> frozenset[str]:
    return frozenset(words.split())


@dataclass(frozen=True)
class Lexicon:
    # Signals, anchors, generic and stop words, aliases, phrases, and what each source counts.
    signals: frozenset[str] = _set(
        "ai ai-agent ai-agents artificial-intelligence computer-vision deep-learning diffusion-model embedding embeddings generative-ai "
        "large-language-model large-language-models llm llms machine-learning model-inference multimodal natural-language-processing "
        "neural-network neural-networks rag retrieval-augmented-generation transformer transformers"
    )
    signal_parts: frozenset[str] = _set("rag llm llms")
    signal_prefix: str = "ai-"
    anchors: frozenset[str] = _set("agent agents embedding embeddings inference llm llms multimodal rag transformer transformers vision")
    suffixes: frozenset[str] = _set("embedding embeddings inference llm llms multimodal rag transformer transformers vision")
    generic: frozenset[str] = _set("api app application cli framework github javascript library open-source python rust sdk typescript")
    stopwords: frozenset[str] = _set("a an and are as at be by for from in is it of on or that the this to with your")
    broad: frozenset[str] = _set("ai artificial-intelligence deep-learning large-language-model large-language-models llm llms machine-learning")
    broad_communities: frozenset[str] = _set(
        "ai artificial-intelligence deep-learning generative-ai large-language-model large-language-models llm llms machine-learning"
    )
    aliases: dict[str, str] = field(default_factory=lambda: {"artificial-intelligence": "ai", "graphrag": "graph-rag", "retrieval-augmented-generation": "rag"})
    phrases: tuple[str, ...] = (
        "ai agent",
        "ai agents",
        "artificial intelligence",
        "computer vision",
        "deep learning",
        "generative ai",
        "large language model",
        "large language models",
        "machine learning",
        "natural language processing",
        "neural network",
        "neural networks",
        "retrieval augmented generation",
    )
    #: Source -> confidence, hundredths for the first and for two or more signals.
    sources: dict[str, tuple[float, int, int]] = field(default_factory=lambda: {"topics": (0.95, 65, 80), "description": (0.8, 45, 60), "readme": (0.65, 30, 45)})
    related: int = 50
    review: int = 25
    emerging: int = 5
    readme_limit: int = 12_000
    # Fixed values as well: districts, their order, and acronyms.
    #: District -> keywords, the first district that matches; and the order in which districts are shown.
    districts: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {
            "embodied-ai": ("robot", "robotic", "robotics", "embodied", "autonomous-driving"),
            "multimodal": ("multimodal", "vision", "image", "video", "audio", "speech", "diffusion"),
            "knowledge-data": ("rag", "retrieval", "knowledge", "graph", "vector", "embedding", "database"),
            "agents": ("agent", "agents", "agentic", "mcp", "tool-use", "browser-use", "automation"),
            "ai-development": ("code", "coding", "codex", "developer", "copilot", "code-generation"),
            "infrastructure": ("inference", "serving", "mlops", "gpu", "cuda", "distributed", "runtime", "deployment"),
            "models": ("model", "models", "transformer", "transformers", "llm", "llms", "fine-tuning", "training"),
        }
    )
    shown: tuple[str, ...] = ("models", "agents", "knowledge-data", "ai-development", "multimodal", "infrastructure", "embodied-ai", "frontier")
    other: str = "frontier"
    acronyms: frozenset[str] = _set("ai llm mcp rag")
