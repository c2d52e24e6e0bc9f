"""Header synonyms, defaults, thresholds, weights and labels.

These are data, not logic.  They must hold exactly these values for results
to be comparable with existing portfolios, so they are listed in one place.
"""

# --- fixed values: header resolution -------------------------------------

FUZZY_CUTOFF = 0.78

PROJECT_SYNONYMS = {
    "project_id": ["proj_id", "id", "project_code", "scheme_id", "work_id"],
    "project_name": ["name", "project_title", "work_name", "title"],
    "state": ["state_name", "state_ut"],
    "district": ["district_name"],
    "mp_name": ["mp", "member_of_parliament", "mp_full_name", "member_name"],
    "project_type": ["work_type", "category", "scheme_type", "type"],
    "sanctioned_amount": ["sanctioned_amt", "amount_sanctioned", "sanction_amount", "sanctioned_amount_rs"],
    "released_amount": ["released_amt", "amount_released", "fund_released"],
    "utilized_amount": ["utilized_amt", "amount_utilized", "expenditure", "amount_spent", "utilised_amount"],
    "completion_percentage": [
        "physical_progress", "progress_percentage", "completion_pct", "physical_progress_percentage"],
    "sanction_date": ["approval_date", "date_of_sanction"],
    "start_date": ["commencement_date", "work_start_date", "date_of_commencement"],
    "expected_completion_date": ["target_completion_date", "due_date", "expected_date_of_completion"],
    "actual_completion_date": ["completion_date", "actual_end_date", "date_of_completion"],
    "latitude": ["lat"],
    "longitude": ["lon", "lng"],
    "contractor": ["contractor_name", "vendor", "vendor_name", "agency_contractor"],
    "agency": ["implementing_agency", "executing_agency", "nodal_agency"],
    "status": ["project_status", "current_status", "work_status"],
    "financial_progress_ratio": ["financial_progress", "fund_utilization_ratio"],
}

DOCUMENT_SYNONYMS = {
    "document_id": ["doc_id"],
    "project_id": ["proj_id", "id", "project_code"],
    "document_type": ["doc_type", "type"],
    "amount": ["document_amount", "claimed_amount"],
    "contractor": ["contractor_name", "vendor"],
    "location": ["document_location", "site_location"],
    "extracted_text": ["ocr_text", "text", "description"],
    "status": ["document_status"],
}

IMAGE_SYNONYMS = {
    "image_id": ["img_id"],
    "project_id": ["proj_id", "id", "project_code"],
    "image_hash": ["hash", "perceptual_hash", "phash"],
    "similarity_score": ["max_similarity", "similarity"],
    "status": ["image_status"],
}

INSPECTION_SYNONYMS = {
    "inspection_id": ["insp_id"],
    "project_id": ["proj_id", "id", "project_code"],
    "inspection_score": ["score", "quality_score"],
    "inspection_status": ["status", "result"],
    "remarks": ["comments", "notes"],
}

# Texts read as missing by the usual tabular readers.
CSV_MISSING_MARKS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# --- fixed values: signals -------------------------------------------------

# In this order the weighted terms are added up.
SIGNAL_WEIGHTS = {
    "financial": 0.13,
    "delay": 0.13,
    "progress": 0.14,
    "contractor": 0.10,
    "document": 0.10,
    "image": 0.10,
    "inspection": 0.10,
    "ml_anomaly": 0.05,
    "duplicate": 0.05,
    "geo": 0.05,
    "citizen": 0.05,
}

SIGNAL_INPUTS = {
    "financial": ["sanctioned_amount", "utilized_amount", "released_amount"],
    "delay": ["start_date", "expected_completion_date"],
    "progress": ["completion_percentage", "financial_progress_ratio"],
    "contractor": ["contractor", "completion_percentage"],
    "document": ["__documents_file__"],
    "image": ["__images_file__"],
    "inspection": ["__inspections_file__"],
    "ml_anomaly": ["completion_percentage", "sanctioned_amount", "utilized_amount"],
    "duplicate": ["project_name"],
    "geo": ["latitude", "longitude"],
    "citizen": ["__always_available__"],
}

SCORE_COLUMN = {
    "financial": "financial_risk_score",
    "delay": "delay_risk_score",
    "progress": "progress_risk_score",
    "contractor": "contractor_risk_score",
    "document": "document_risk_score",
    "image": "image_risk_score",
    "inspection": "inspection_risk_score",
    "ml_anomaly": "ml_anomaly_score",
    "duplicate": "duplicate_risk_score",
    "geo": "geo_risk_score",
    "citizen": "citizen_risk_score",
}

FLAG_COLUMN = {
    "financial": "financial_anomaly",
    "delay": "delay_anomaly",
    "progress": "progress_anomaly",
    "contractor": "contractor_anomaly",
    "document": "document_anomaly",
    "image": "image_anomaly",
    "inspection": "inspection_anomaly",
    "ml_anomaly": "ml_anomaly",
    "duplicate": "duplicate_anomaly",
    "geo": "geo_anomaly",
    "citizen": "citizen_anomaly",
}

# Ten signals are reported in the frequency table; contractor is not one.
SIGNAL_LABELS = {
    "financial_anomaly": "Financial",
    "delay_anomaly": "Delay",
    "progress_anomaly": "Progress",
    "document_anomaly": "Document",
    "image_anomaly": "Image",
    "inspection_anomaly": "Inspection",
    "ml_anomaly": "ML Anomaly",
    "duplicate_anomaly": "Duplicate",
    "geo_anomaly": "Geo-Spatial Overlap",
    "citizen_anomaly": "Citizen Reported",
}

# Any one of these raises an alert without the overall score.
SHARP_SIGNALS = ["financial", "document", "image", "duplicate", "geo", "ml_anomaly", "citizen"]

OUTLIER_FEATURES = {
    "utilization_percentage": "fund utilization",
    "completion_percentage": "physical completion",
    "progress_mismatch_abs": "financial-vs-physical progress mismatch",
    "delay_days": "schedule delay",
}

REPORT_CATEGORIES = ["DOCUMENT_MISMATCH", "OTHER", "POOR_QUALITY", "PROJECT_INACTIVE", "SUSPECTED_CORRUPTION"]
DECISIONS = ["VERIFIED", "DISMISSED", "FIELD_INSPECTION", "ESCALATED"]

EARTH_RADIUS_KM = 6371.0
OVERLAP_KM = 0.3
TEXT_SIMILARITY = 0.55
MIN_ROWS_FOR_PAIRS = 5

# --- fixed values: English stop words of Spark's StopWordsRemover ----------

ENGLISH_STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers
herself it its itself they them their theirs themselves what which who whom this that these those am is are
was were be been being have has had having do does did doing a an the and but if or because as until while of
at by for with about against between into through during before after above below to from up down in out on
off over under again further then once here there when where why how all any both each few more most other
some such no nor not only own same so than too very s t can will just don should now i'll you'll he'll she'll
we'll they'll i'd you'd he'd she'd we'd they'd i'm you're he's she's it's we're they're i've we've you've
they've isn't aren't wasn't weren't haven't hasn't hadn't don't doesn't didn't won't wouldn't shan't shouldn't
mustn't can't couldn't cannot could here's how's let's ought that's there's what's when's where's who's why's
would
""".split()
