"""Column layouts and fixed lookup values shared by all layers."""

from __future__ import annotations

# One landed page of an Atom feed.
PAGE = "category string, page_start bigint, payload string"

# One entry of a feed. Every scalar element is read as a list: a repeated element then
# keeps its first occurrence, where a plain string field would silently keep the last.
ENTRY = """
    id array<string>, title array<string>, summary array<string>,
    published array<string>, updated array<string>,
    author array<struct<name array<string>>>,
    category array<struct<_term string>>,
    link array<struct<_title string, _href string>>
"""

FEED = f"entry array<struct<{ENTRY}>>, _corrupt_record string"

BRONZE = """
    id string, title string, summary string, authors array<string>, categories array<string>,
    published_date timestamp, updated_date timestamp, pdf_url string
"""

SILVER = """
    id string, title string, summary string, authors array<string>, categories array<string>,
    published_date date, updated_date date, pdf_url string, publication_year int
"""

DIM = "category_code string, category_name string"

FACT = "category_name string, paper_count bigint, publication_year int"

BRONZE_COLUMNS = [
    "id", "title", "summary", "authors", "categories", "published_date", "updated_date", "pdf_url",
]
SILVER_COLUMNS = [*BRONZE_COLUMNS, "publication_year"]

# Category codes with their readable names. The order is the fetch
# order and decides which copy of a paper listed in several categories is kept.
CATEGORY_NAMES = {
    "cs.AI": "Artificial Intelligence",
    "cs.CL": "Computation and Language",
    "cs.CC": "Computational Complexity",
    "cs.CE": "Computational Engineering, Finance, and Science",
    "cs.CG": "Computational Geometry",
    "cs.GT": "Computer Science and Game Theory",
    "cs.CV": "Computer Vision and Pattern Recognition",
    "cs.CY": "Computers and Society",
    "cs.CR": "Cryptography and Security",
    "cs.DS": "Data Structures and Algorithms",
    "cs.DB": "Databases",
    "cs.DL": "Digital Libraries",
    "cs.DM": "Discrete Mathematics",
    "cs.DC": "Distributed, Parallel, and Cluster Computing",
    "cs.ET": "Emerging Technologies",
    "cs.FL": "Formal Languages and Automata Theory",
    "cs.GL": "General Literature",
    "cs.GR": "Graphics",
    "cs.AR": "Hardware Architecture",
    "cs.HC": "Human-Computer Interaction",
    "cs.IR": "Information Retrieval",
    "cs.IT": "Information Theory",
    "cs.LG": "Machine Learning",
    "cs.LO": "Logic in Computer Science",
    "cs.MS": "Mathematical Software",
    "cs.MA": "Multiagent Systems",
    "cs.MM": "Multimedia",
    "cs.NI": "Networking and Internet Architecture",
    "cs.NE": "Neural and Evolutionary Computing",
    "cs.NA": "Numerical Analysis",
    "cs.OS": "Operating Systems",
    "cs.OH": "Other Computer Science",
    "cs.PF": "Performance",
    "cs.PL": "Programming Languages",
    "cs.RO": "Robotics",
    "cs.SI": "Social and Information Networks",
    "cs.SE": "Software Engineering",
    "cs.SD": "Sound",
    "cs.SC": "Symbolic Computation",
    "cs.SY": "Systems and Control",
}
CATEGORY_CODES = list(CATEGORY_NAMES)
