"""Word lists and patterns that decide the results."""

from __future__ import annotations

# Section names in matching order, each with its heading keywords.
SECTION_KEYWORDS: dict[str, tuple[str, ...]] = {
    "abstract": ("abstract",),
    "introduction": ("introduction", "background"),
    "related_work": ("related work", "literature review", "prior work", "previous work"),
    "methodology": (
        "method", "methodology", "approach", "model", "architecture",
        "proposed method", "proposed approach", "our approach", "our method",
    ),
    "experiments": (
        "experiment", "experimental setup", "experimental results",
        "experimental design", "evaluation setup",
    ),
    "results": ("results", "findings", "performance", "experimental results"),
    "discussion": ("discussion", "analysis", "ablation study", "ablation studies"),
    "conclusion": (
        "conclusion", "conclusions", "concluding remarks", "future work",
        "summary", "limitations",
    ),
    "references": ("references", "bibliography", "works cited"),
}

# Entity types with their patterns; each pattern is matched on its own.
# The words after a pattern save time: without one of them, in any case, it cannot match.
ENTITY_PATTERNS: tuple[tuple[str, str, tuple[str, ...]], ...] = (
    ("models", r"(?i)\b(GPT-?[0-9.]+[a-z]*|GPT|ChatGPT)\b", ("gpt",)),
    ("models", r"\b(BERT|RoBERTa|ALBERT|DistilBERT|DeBERTa|SciBERT)\b", ("bert",)),
    ("models", r"\b(T5|FLAN-T5|mT5)\b", ("t5",)),
    ("models", r"(?i)\b(LLaMA|Llama-?[0-9]*)\b", ("llama",)),
    ("models", r"\b(Claude|Gemini|Mistral|Mixtral)\b", ("claude", "gemini", "mistral", "mixtral")),
    ("models", r"(?i)\b(ResNet|VGG|Inception|DenseNet|EfficientNet)[-\s]?[0-9]*", ("resnet", "vgg", "inception", "densenet", "efficientnet")),
    ("models", r"(?i)\b(YOLO|YOLOv[0-9]+)\b", ("yolo",)),
    ("models", r"(?i)\b(ViT|Vision Transformer|Swin Transformer)\b", ("vit", "transformer")),
    ("models", r"(?i)\b(CLIP|DALL-?E|Stable Diffusion)\b", ("clip", "dall", "diffusion")),
    ("models", r"\b(Transformer|LSTM|GRU|BiLSTM)\b", ("transformer", "lstm", "gru")),
    ("datasets", r"(?i)\b(ImageNet[-\s]?[0-9]*k?)\b", ("imagenet",)),
    ("datasets", r"(?i)\b(COCO|MS-?COCO)\b", ("coco",)),
    ("datasets", r"(?i)\b(CIFAR-?(?:10|100))\b", ("cifar",)),
    ("datasets", r"(?i)\b(MNIST|Fashion-?MNIST)\b", ("mnist",)),
    ("datasets", r"(?i)\b(SQuAD[0-9.]*)\b", ("squad",)),
    ("datasets", r"\b(GLUE|SuperGLUE)\b", ("glue",)),
    ("datasets", r"(?i)\b(WikiText[-\s]?[0-9]*)\b", ("wikitext",)),
    ("datasets", r"(?i)\b(Common Crawl|C4)\b", ("common crawl", "c4")),
    ("datasets", r"(?i)\b(ADE20K|Cityscapes|Pascal VOC)\b", ("ade20k", "cityscapes", "pascal voc")),
    ("metrics", r"(?i)\b(accuracy|precision|recall|F1[-\s]?score)\b", ("accuracy", "precision", "recall", "f1")),
    ("metrics", r"(?i)\b(BLEU[-\s]?[0-9]*|ROUGE[-\s]?[LN0-9]*)\b", ("bleu", "rouge")),
    ("metrics", r"\b(mAP|IoU|mIoU)\b", ("map", "iou")),
    ("metrics", r"(?i)\b(perplexity|cross-entropy)\b", ("perplexity", "cross-entropy")),
    ("metrics", r"(?i)\b(AUC|ROC|AUC-ROC)\b", ("auc", "roc")),
    ("metrics", r"\b(METEOR|CIDEr|SPICE)\b", ("meteor", "cider", "spice")),
    ("frameworks", r"(?i)\b(PyTorch|TensorFlow|JAX|Keras)\b", ("pytorch", "tensorflow", "jax", "keras")),
    ("frameworks", r"(?i)\b(Hugging ?Face|HuggingFace)\b", ("hugging",)),
    ("frameworks", r"(?i)\b(scikit-learn|sklearn)\b", ("scikit-learn", "sklearn")),
)

# Entity types that every document reports, in output order.
ENTITY_TYPES: tuple[str, ...] = ("models", "datasets", "metrics", "frameworks", "techniques")

# Words that mark a sentence as a process step (matched as substrings).
STEP_INDICATORS: tuple[str, ...] = (
    "first", "second", "third", "then", "next", "finally", "after",
    "step", "stage", "phase", "process", "procedure",
)
STEP_VERBS: tuple[str, ...] = (
    "train", "test", "evaluate", "collect", "preprocess", "extract",
    "compute", "calculate", "apply", "use", "implement", "generate",
    "propose", "develop", "design", "construct", "build", "optimize",
)

# English function words left out of keywords; callers can pass their own list.
STOP_WORDS: tuple[str, ...] = tuple(
    """
    about above after again against all also am an and any are as at be because been before
    being below between both but by can could did do does doing down during each few for from
    further had has have having he her here hers herself him himself his how however if in into
    is it its itself just may me might more most must my myself no nor not now of off on once
    only or other our ours ourselves out over own same shall she should so some such than that
    the their theirs them themselves then there these they this those through thus to too under
    until up upon very via was we were what when where which while who whom whose why will with
    within without would yet you your yours yourself yourselves
    """.split()
)

# Abbreviations whose full stop does not end a sentence.
ABBREVIATIONS: tuple[str, ...] = (
    "et al", "Fig", "Figs", "Eq", "Eqs", "Sec", "Tab", "Ref", "cf", "vs", "e.g", "i.e", "resp", "approx",
)
