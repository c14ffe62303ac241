"""Word lists, entity types and patterns that decide the results.

They are kept here together as plain text so that they can be read and compared.
"""

# Sentiment lexicon teacher.
SENTIMENT_WORDS = (
    "amazing", "awful", "bad", "beautiful", "best", "boring", "brilliant", "charming", "dreadful",
    "excellent", "fantastic", "fun", "funny", "good", "great", "hated", "horrible", "impressive",
    "interesting", "lame", "loved", "masterpiece", "moving", "poor", "powerful", "ridiculous",
    "stupid", "superb", "terrible", "thrilling", "wonderful", "worst", "waste", "weak",
)
NEGATORS = ("not", "never", "no", "neither", "hardly", "barely", "isn't", "wasn't")
INTENSIFIERS = ("absolutely", "extremely", "really", "so", "too", "very", "surprisingly")

# Section words and generic modifiers that are never sensitive on their own.
CLINICAL_STOP = (
    "diagnosis", "diagnoses", "procedure", "procedures", "history", "impression", "indication",
    "indications", "findings", "finding", "examination", "exam", "technique", "comparison",
    "assessment", "plan", "description", "preoperative", "postoperative", "operative", "disposition",
    "complaints", "complaint", "consultation", "reason", "left", "right", "bilateral", "lateral",
    "medial", "anterior", "posterior", "superior", "inferior", "upper", "lower", "negative",
    "positive", "normal", "abnormal", "general", "present", "absent", "stable", "unremarkable",
    "gross", "patient", "male", "female", "estimated", "performed", "well", "without",
)

# A small default; pass the full list of your NER model's language as ``stop_words``.
STOP_WORDS = (
    "a", "about", "after", "all", "an", "and", "any", "are", "as", "at", "be", "been", "but", "by",
    "can", "did", "do", "for", "from", "had", "has", "have", "he", "her", "his", "i", "if", "in",
    "into", "is", "it", "its", "me", "my", "no", "not", "of", "on", "or", "our", "she", "so", "than",
    "that", "the", "their", "them", "then", "there", "they", "this", "to", "up", "was", "we", "were",
    "what", "when", "which", "who", "will", "with", "would", "you", "your",
)

# Semantic type ids of sensitive medical concepts.
SENSITIVE_CONCEPT_TYPES = (
    "T047", "T048", "T191", "T046", "T184", "T037", "T019", "T050", "T121", "T200", "T109", "T195",
    "T061", "T060", "T059", "T034", "T033", "T023", "T116", "T123", "T005", "T007", "T004", "T204",
)

# Entity types kept by each policy.
FULL_ENTITY_TYPES = ("PERSON", "ORG", "GPE", "LOC", "FAC", "NORP", "MONEY", "PERCENT")
STRICT_ENTITY_TYPES = ("PERSON", "ORG", "GPE", "LOC", "FAC", "NORP")
PLACE_TYPES = ("GPE", "LOC", "FAC")

# A DATE counts only with a year and when it is not a duration.
YEAR_PATTERN = r"\b(19|20)\d\d\b"
DURATION_PATTERN = r"(?i)^\s*(about |around |~)?\d+\s*(day|week|month|year|hour|min|yr|mo|wk)s?\b"

# Dosage units.
DOSAGE_UNITS = ("mg", "mcg", "g", "kg", "ml", "l", "iu", "units", "unit", "mm", "cm")

# Texts that stand for a deleted post.
DELETED = ("[deleted]", "[removed]")
DELETED_SPACED = ("[deleted]", "[removed]", "[ deleted ]", "[ removed ]")
