"""What a ranking looks for: an immutable profile, passed to every operator that needs it."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from datetime import date

# Terms, weights and thresholds that results depend on.
CONCEPTS = {
    "ranking": ["ranking system", "ranking systems", "ranking model", "ranking models", "learning to rank", "learning-to-rank", "candidate ranking", "re-rank", "re-ranking", "re-ranked", "rerank", "reranking", "reranked"],
    "recommendation": ["recommendation system", "recommendation systems", "recommendation engine", "recommendation engines", "recommender", "recommenders", "recsys", "rec sys"],
    "search": ["search engine", "search engines", "search system", "search systems", "semantic search"],
    "retrieval": ["information retrieval", "retrieval system", "retrieval systems", "vector search", "embedding-based retrieval", "embeddings-based retrieval", "dense retrieval", "retrieval"],
    "hybrid search": ["hybrid retrieval", "hybrid search", "bm25", "dense vector", "sparse vector", "vector database", "vector databases", "vector index", "vector indexes", "faiss", "pinecone", "weaviate", "qdrant", "milvus", "opensearch", "elasticsearch"],
    "relevance": ["relevance", "personalization", "personalisation"],
    "matching": ["matching system", "matching systems"],
    "evaluation": ["evaluation framework", "evaluation frameworks", "eval framework", "eval frameworks", "ndcg", "mrr", "map", "a/b test", "a/b testing", "ab test", "ab testing", "offline/online evaluation", "offline evaluation", "online evaluation"],
}
GENERIC = ["machine learning model", "machine learning models", "ml model", "ml models", "deployed", "production model", "production models", "trained a model", "trained models", "deep learning", "neural network", "neural networks", "embeddings", "embedding", "transformer", "transformers", "fine-tuning", "fine-tuned", "nlp", "llm", "llms", "rag", "a/b test", "ab test", "click-through", "ctr"]
POSITIVE = ["nlp", "natural language", "information retrieval", "retrieval", "ranking", "rankings", "recommendation", "recommendations", "recommender", "recommenders", "search", "semantic", "embedding", "embeddings", "llm", "llms"]
NEGATIVE = ["computer vision", "image classification", "object detection", "yolo", "speech recognition", "tts", "asr", "robotics", "autonomous", "lidar", "gans"]
RESEARCH = ["research", "researcher", "researchers", "phd", "publication", "publications", "paper", "papers", "academic", "thesis"]
PRODUCTION = ["production", "deployed", "shipped", "users", "scale", "platform", "platforms", "live"]
SCOPE = ["led", "owned", "designed", "architected", "at scale", "end-to-end", "production", "drove", "built and shipped"]
CITIES = ["pune", "noida", "hyderabad", "mumbai", "delhi", "gurgaon", "gurugram", "ncr"]
SECOND_CITIES = ["bangalore", "bengaluru"]
SERVICES = ["tcs", "tata consultancy", "infosys", "wipro", "accenture", "cognizant", "capgemini", "hcl", "tech mahindra", "mindtree", "ltimindtree", "mphasis", "dxc", "larsen", "l&t infotech"]
PRODUCT_INDUSTRIES = ["AI/ML", "AdTech", "Consumer Electronics", "Conversational AI", "E-commerce", "EdTech", "Fintech", "Food Delivery", "Gaming", "HealthTech", "HealthTech AI", "Insurance Tech", "Internet", "Media", "SaaS", "Software", "Transportation", "Voice AI"]
SERVICES_INDUSTRIES = ["Consulting", "IT Services"]
FIT_WEIGHTS = {"technical": 0.45, "seniority": 0.22, "product": 0.10, "location": 0.12, "education": 0.03, "stability": 0.08}
ENGAGEMENT_WEIGHTS = {"availability": 0.30, "responsiveness": 0.30, "recency": 0.25, "credibility": 0.15}
BANDS = {"one": 0.7, "two": 0.85, "three": 1.0, "support": 0.6, "generic": 0.5, "disclaimer": 0.55}
NEGATION = r"(?:\bthan|\bnot|\bno|\bnever|\bwithout|\binstead of)"
ASPIRATION = r"\b(?:looking (?:for|to)|seeking|open to|interested in|aspir\w*|hoping to|hope(?:s)? to|aiming (?:for|to)|keen (?:on|to)|closer to|grow into|want(?:s)? to|plan(?:s|ning)? to|transition(?:ing)? (?:to|into)|would love to|taking (?:online )?(?:courses?|classes?)|enrolled in|experimenting|exploring|learning about|studying|side project|excited about)\b"
DISCLAIMER = r"\b(?:lighter on the deep.?learning|lighter weight than|not my strongest|still building depth|building depth on)\b"
TECH_TITLE = r"(?:ml|ai|software|data|nlp|search|backend|full.?stack|platform|infrastructure|devops|sre|cloud|site.reliability|applied|research|deep.learning|machine.learning|computer.vision)\s+(?:engineer|scientist|architect|developer|analyst)|developer|scientist|machine learning|deep learning|nlp"
REJECTED_TITLE = r"\b(?:computer\s+vision|cv\s+engineer|speech|asr|robotics?|perception|image\s+classification|object\s+detection)\b"
ARCHETYPES = {"ELITE": "focus on search, retrieval, and ranking", "STRONG": "strong background in nlp", "SENIOR_ENG": "building systems that connect users with relevant information", "GENERIC": "predictive modeling, nlp, analytics"}
LOOSE_ARCHETYPES = {"ELITE": "search, retrieval, and ranking", "STRONG": "strong background in nlp", "GENERIC": "predictive modeling"}
OFF_LEXICON = ["discovery engine", "discovery system", "search relevance", "relevance engineering", "query understanding", "feed ranking", "feed ranker", "matching engine", "matching algorithm", "matchmaking", "recommendation pipeline", "ad ranking", "content ranking", "two-tower", "two tower", "collaborative filtering", "content-based filtering", "nearest neighbor", "approximate nearest neighbor", "ann index", "solr", "lucene", "vespa", "algolia", "typesense", "hnsw", "scann", "annoy", "personalization engine", "ranker", "ranking pipeline", "search pipeline", "search ranking", "ltr"]


@dataclass(frozen=True)
class JobProfile:
    """Lexicons, weights and thresholds of one job."""

    today: date = date(2026, 6, 9)
    concepts: dict = field(default_factory=lambda: CONCEPTS)
    generic: tuple = tuple(GENERIC)
    positive: tuple = tuple(POSITIVE)
    negative: tuple = tuple(NEGATIVE)
    research: tuple = tuple(RESEARCH)
    production: tuple = tuple(PRODUCTION)
    scope: tuple = tuple(SCOPE)
    cities: tuple = tuple(CITIES)
    second_cities: tuple = tuple(SECOND_CITIES)
    home_country: str = "india"
    services: tuple = tuple(SERVICES)
    product_industries: tuple = tuple(PRODUCT_INDUSTRIES)
    services_industries: tuple = tuple(SERVICES_INDUSTRIES)
    weights: dict = field(default_factory=lambda: dict(FIT_WEIGHTS))
    engagement: dict = field(default_factory=lambda: dict(ENGAGEMENT_WEIGHTS))
    bands: dict = field(default_factory=lambda: dict(BANDS))
    semantic_share: float = 0.2
    floor: float = 0.6
    chaser: float = 0.75
    notice_free: float = 30.0
    notice_end: float = 180.0
    #: Added to credibility for each of at most two assessments of 70 or more in a wanted domain.
    assessment_bonus: float = 0.0
    archetypes: dict = field(default_factory=lambda: ARCHETYPES)
    loose_archetypes: dict = field(default_factory=lambda: LOOSE_ARCHETYPES)
    off_lexicon: tuple = tuple(OFF_LEXICON)
    negation: str = NEGATION
    aspiration: str = ASPIRATION
    disclaimer: str = DISCLAIMER
    tech_title: str = TECH_TITLE
    rejected_title: str = REJECTED_TITLE

    def but(self, **changes) -> JobProfile:
        """A copy with changes; inside a dict field, `weights={"technical": .5}` changes that key alone."""
        merged = {k: ({**getattr(self, k), **v} if isinstance(v, dict) and k in ("weights", "engagement", "bands", "concepts") else v) for k, v in changes.items()}
        return replace(self, **merged)


def corpus_profile() -> JobProfile:
    """Terms that occur in the synthetic documents, where the job's own do not."""
    words = {"this": ["this"], "from": ["from"], "other": ["ther", "ther the"], "with": ["with", "with the"], "for": ["for"], "that": ["that"]}
    return JobProfile(today=date(2024, 2, 1), concepts=words, generic=("and", "which"), positive=("with", "this"), negative=("der", "die"), research=("les", "est"), production=("the",), scope=("of the", "in the"), home_country="india", product_industries=("BUILDING", "MACHINERY"), services_industries=("FURNITURE",), archetypes={"ELITE": "with the", "STRONG": "from the", "SENIOR_ENG": "that the", "GENERIC": "this"}, loose_archetypes={"ELITE": "with th", "STRONG": "from th", "GENERIC": "thi"}, off_lexicon=("and the", "which", "have", "not", "they"))
