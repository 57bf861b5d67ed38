"""Names, word lists, cut-offs and dates that decide results.

Everything here is data. Operators take these as parameters; the values below
are only the defaults.
"""

# ---------------------------------------------------------------- fixed values
DATE_START = "2023-06-01"
DATE_END = "2024-07-31"
SEED = 42
DELETED_MARKERS = ("[deleted]", "[removed]")

ACTIVITY_COMMUNITIES = (
    "MachineLearning", "ArtificialInteligence", "OpenAI", "ChatGPT", "technology",
    "Futurology", "technews", "TechNewsToday", "AIforGood",
)
RETENTION_COMMUNITIES = (
    "MachineLearning", "AIethics", "GenerativeAI", "ReinforcementLearning", "AI_Research",
    "AI_Programming", "AI_Agents", "deeplearning", "ChatGPT", "OpenAI",
)
GINI_COMMUNITIES = (
    "ChatGPT", "OpenAI", "ArtificialInteligence", "technology", "datascience", "AI_Art",
    "MachineLearning", "GenerativeAI", "TechCulture", "AI_Research",
)
OVERLAP_COMMUNITIES = (
    "technology", "technews", "science", "Futurology", "ArtificialInteligence",
    "MachineLearning", "OpenAI", "ChatGPT", "robotics",
)
DISCUSSION_COMMUNITIES = (
    "MachineLearning", "ArtificialInteligence", "AIethics", "Futurology", "technology",
    "AI_Art", "AIforGood", "TechCulture",
)
NETWORK_COMMUNITIES = (
    "MachineLearning", "ArtificialInteligence", "ChatGPT", "OpenAI", "technology",
    "Futurology", "AIethics", "AIforGood",
)

# The communities the ingest job keeps unless the caller names others.
INGEST_COMMUNITIES = (
    "MachineLearning", "ArtificialInteligence", "OpenAI", "ChatGPT", "Futurology", "technology",
    "AIethics", "deeplearning", "AI_Agents", "GenerativeAI", "genai", "DeepLearningAI",
    "NeuralNetworks", "AI_Research", "MLQuestions", "ReinforcementLearning", "ComputerVision",
    "AI_Art", "LLM", "AI_Programming",
    "programming", "datascience", "bigdata", "computerscience", "coding", "learnprogramming",
    "robotics", "DataIsBeautiful", "technews", "Python", "JavaScript", "Rust", "GoLang", "Linux",
    "OpenSource", "CyberSecurity", "Hacking", "DevOps", "CloudComputing", "webdev",
    "programmerhumor", "cscareerquestions", "learnpython", "learnjava",
    "science", "Physics", "Chemistry", "Biology", "Mathematics", "Astronomy", "Space",
    "EarthScience", "Geology", "Neuroscience", "EnvironmentalScience", "Engineering",
    "ElectricalEngineering", "MechanicalEngineering", "CivilEngineering", "MaterialsScience",
    "Statistics", "QuantumComputing", "Genetics", "Ecology", "Bioinformatics", "Nanotechnology",
    "Energy", "RoboticsEngineering", "ComputerEngineering", "TechInnovation", "Astrophysics",
    "ScientificResearch", "ScienceNews", "FutureTechnology", "AIinScience", "SpaceX", "NASA",
    "Cosmology", "futurescience", "biologymemes", "physicsmemes", "spaceflight",
    "TechNewsToday", "TechTalk", "Innovation", "Futurism", "TechCulture", "AIforGood",
    "TechEntrepreneur", "Startups", "EdTech", "QuantumPhysics", "Blockchain", "Cryptography",
    "MachineLearningMemes", "DataScienceMemes", "gadgets", "tech", "futurewhatif", "Entrepreneur",
)

COMMENT_COLUMNS = (
    "id", "subreddit", "author", "body", "score", "created_utc", "parent_id", "link_id",
    "controversiality", "gilded", "total_awards_received", "permalink",
)
SUBMISSION_COLUMNS = (
    "id", "subreddit", "author", "title", "selftext", "score", "created_utc", "num_comments",
    "url", "over_18", "upvote_ratio", "link_flair_text", "total_awards_received", "permalink",
)
PROFILE_COMMENT_COLUMNS = (
    "subreddit", "author", "score", "created_utc", "id", "body", "parent_id", "link_id",
    "controversiality", "gilded",
)
PROFILE_SUBMISSION_COLUMNS = (
    "subreddit", "author", "score", "created_utc", "id", "title", "selftext", "url",
    "num_comments", "upvote_ratio", "over_18", "link_flair_text",
)

CATEGORIES = {
    "AI/ML": ("ChatGPT", "OpenAI", "ArtificialInteligence", "MachineLearning", "GenerativeAI", "AIethics"),
    "Programming/Data": ("datascience", "bigdata", "programming", "Python", "learnprogramming", "CloudComputing"),
    "Science/STEM": ("science", "Physics", "Engineering", "Astronomy", "Neuroscience", "MaterialsScience"),
    "Tech/Future Trends": ("technology", "Futurology", "TechCulture", "Innovation", "FutureTechnology"),
}

EVENTS = {
    "2023-07-12": "Claude 2 Launch",
    "2023-11-06": "OpenAI Developer Day",
    "2024-02-15": "Gemini Launch",
    "2024-04-17": "EU AI Act",
    "2024-06-20": "GPT-5 Rumors",
}

# Discussion types in order of precedence; a text matching none is "other".
KEYWORD_CLASSES = {
    "technical": ("model", "neural", "training", "parameter", "architecture", "optimizer"),
    "ethical": ("ethic", "bias", "regulation", "moral", "responsible", "fairness"),
    "societal": ("society", "impact", "education", "future", "job", "policy"),
}
OTHER_CLASS = "other"

# Spark's own English stop words (StopWordsRemover), as text for use without a session.
ENGLISH_STOP_WORDS = tuple("""
    i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers
    herself it its itself they them their theirs themselves what which who whom this that these those am is
    are was were be been being have has had having do does did doing a an the and but if or because as until
    while of at by for with about against between into through during before after above below to from up
    down in out on off over under again further then once here there when where why how all any both each
    few more most other some such no nor not only own same so than too very s t can will just don should now
    i'll you'll he'll she'll we'll they'll i'd you'd he'd she'd we'd they'd i'm you're he's she's it's we're
    they're i've we've you've they've isn't aren't wasn't weren't haven't hasn't hadn't don't doesn't didn't
    won't wouldn't shan't shouldn't mustn't can't couldn't cannot could here's how's let's ought that's
    there's what's when's where's who's why's would
""".split())
# Stop words added to Spark's English list before topic modelling.
TOPIC_STOP_WORDS = (
    "would", "could", "get", "like", "one", "think", "know", "see", "im", "dont", "thats", "ive",
    "youre", "cant", "also", "really", "even", "make", "need", "want", "much", "people", "thing",
    "things", "use", "work", "way", "going", "time", "just", "good", "new",
)
# Stop words added to Spark's English list before counting discussion terms.
CLOUD_STOP_WORDS = (
    "ai", "artificial", "intelligence", "machine", "learning", "use", "people", "think", "make",
    "good", "get", "really", "would", "one", "also", "even", "go", "could", "want", "said", "like",
    "thing", "see", "much", "way", "well",
)
CLOUD_MIN_TOKEN_LENGTH = 3
CLOUD_MAX_WORDS = 100

SENTIMENT_CUTOFF = 0.05
QUALITY_THRESHOLD = 20
HASH_FEATURES = 2 ** 16
CLASSIFIER_ITERATIONS = 20
CLUSTER_FEATURES = 2000
CLUSTER_K = 5
ELBOW_MIN_K = 2
ELBOW_MAX_K = 10
CLUSTER_TERMS = 10
TOPIC_COUNT = 10
TOPIC_VOCABULARY = 5000
TOPIC_MIN_DF = 10
TOPIC_ITERATIONS = 20
TOPIC_WORDS = 15
NETWORK_USERS = 500

# Sentiment rule weights as published by Hutto & Gilbert (ICWSM 2014).
VALENCE_NORMALISER = 15.0
BOOSTER_STEP = 0.293
BOOSTER_DAMPING = (1.0, 0.95, 0.9)
CAPS_STEP = 0.733
NEGATION_FACTOR = -0.74
NEVER_SO_FACTOR = 1.25
EXCLAMATION_STEP = 0.292
EXCLAMATION_MAX = 4
QUESTION_STEP = 0.18
QUESTION_MANY = 0.96
CONTRAST_BEFORE = 0.5
CONTRAST_AFTER = 1.5
# ------------------------------------------------------------ end fixed values
