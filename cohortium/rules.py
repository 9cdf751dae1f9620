"""Fixed tables: code maps, word lists, thresholds and texts.

Every operator takes its table as a parameter; the values here are the defaults.
"""

# --------------------------------------------------------------------------
# They must equal the survey's own code lists.
# --------------------------------------------------------------------------

MISSING_TOKENS = ("nan", "none", "na", "")
NULL_TOKENS = ("nan", "none", "")

GENDER = {
    "male": "Male",
    "m": "Male",
    "female": "Female",
    "f": "Female",
    "transgender": "Transgender",
    "trans": "Transgender",
}

AREA = {"urban": "Urban", "rural": "Rural"}
AREA_CODE = {"Urban": 1, "Rural": 0}

MARITAL_CORRECTIONS = {
    "divorcee/seperated": "Divorcee/Separated",
    "divorcee/separated": "Divorcee/Separated",
    "widow/widower": "Widowed",
}

EDUCATION = {
    "no formal schooling": 0,
    "up to primary school": 1,
    "up to high school": 2,
    "up to intermediate": 3,
    "up to university": 4,
    "university completed or higher": 5,
    "specify if any": 5,
}

OCCUPATION = {
    "homemaker": "Homemaker",
    "professional/executive/big business": "Professional",
    "clerical/medium business": "Clerical",
    "self-employed/ skilled": "Self-employed",
    "unskilled/ landless laborer": "Unskilled",
    "retired": "Retired",
    "unemployed(able to work)": "Unemployed",
    "unemployed(unable to work)": "Unemployed",
    "others(specify if any)": "Other",
}

SLEEP = {"very good": 3, "fairly good": 2, "fairly bad": 1, "very bad": 0}
DIET = {"rarely/ never": 2, "sometimes": 1, "usually/often": 0}
MILK = {"usually/often": 2, "sometimes": 1, "rarely/ never": 0}

# answer text without spaces -> minutes per day; the second table is its code form
ACTIVITY_MINUTES = {
    "atleast10mins": 10,
    "10-30mins": 20,
    "30mins-1hr": 45,
    "1hr-1.5hrs": 75,
    ">1.5hrs": 105,
}
ACTIVITY_CODE_MINUTES = {0: 0, 1: 10, 2: 20, 3: 45, 4: 75, 5: 105}

ACTIVITY_WEIGHTS = {"mild": 1.5, "moderate": 4.9, "vigorous": 6.8}
ACTIVITY_OPTIMAL = 1100.0

DURATION_KNOWN_YEARS = 0.6
DURATION_MAX_YEARS = 80

SMOKING_YES_NO = [
    "PreRtobuse", "PreRtobdaily", "PreRtobcurrent", "PreRtobdailyuse",
    "PreRstouse", "PreRstodaily", "PreRstocurrent", "PreRstodailyuse",
]
SMOKING_COUNTS = ["PreRtobaverage", "PreRtobsmoking", "PreRstoyear"]
ALCOHOL_YES_NO = ["PreRalcoholuse", "PreRalthreemonths", "PreRallastmonth"]
ALCOHOL_COUNTS = [
    "PreRalyear", "PreRalthreemonthsuse", "PreRallastmonthuse",
    "PreRlastmonthavg", "PreRdrinktype", "PreRalmlperday",
]
FAMILY_YES_NO = ["PreRdiafather", "PreRdiamother", "PreRdiabrother", "PreRdiasister", "PreRcurrentworking"]
ACTIVITY_COLUMNS = {
    "mild": "PreRmildactivityduration",
    "moderate": "PreRmoderateduration",
    "vigorous": "PreRvigorousduration",
}
DIET_COLUMNS = [
    "PreRskipbreakfast", "PreRlessfiber", "PreRlessfruit", "PreRlessvegetable",
    "PreRmeat", "PreRfriedfood", "PreRpopcorn", "PreRsweet", "PreRdrink",
]

# label -> code, one map per kind of source; a label without a code becomes null
SOURCE_CODES = {
    "PreRgender": {
        "known_cases": {"Male": 1, "Female": 0, "Transgender": 2},
        "new_cases": {"Male": 1, "Female": 0},
        "pre_post": {"Male": 1, "Female": 0},
    },
    "PreRarea": {
        "known_cases": {"Urban": 1, "Rural": 0},
        "new_cases": {"Urban": 1, "Rural": 0},
        "pre_post": {"Urban": 1, "Rural": 0},
    },
}

COLUMN_RENAMES = {"postblage": "PostBLAge", "PreRgender": "PreBLGender"}

TARGET = "PostBLHBA1C"

# the columns a null report watches and a cleaned file keeps
MONITORED_COLUMNS = [
    "PostBLHBA1C", "PostRgroupname", "PreBLAge", "PreRgender", "PreRarea", "PreRmaritalstatus",
    "PreReducation", "PreRpresentoccupation", "PreRcurrentworking", "PreRdiafather",
    "PreRdiamother", "PreRdiabrother", "PreRdiasister", "PreRtobuse", "PreRtobdaily",
    "PreRtobcurrent", "PreRtobdailyuse", "PreRtobaverage", "PreRtobsmoking",
    "PreRstouse", "PreRstodaily", "PreRstocurrent", "PreRstodailyuse", "PreRstoyear",
    "PreRalcoholuse", "PreRalyear", "PreRalthreemonths", "PreRalthreemonthsuse",
    "PreRallastmonth", "PreRallastmonthuse", "PreRlastmonthavg", "PreRdrinktype",
    "PreRalmlperday", "PreRsleepquality", "PreRstworkvalue", "PreRstfamilyvalue",
    "PreRsthealthvalue", "PreRstfinancialvalue", "PreRstsocialvalue",
    "PreRmildactivityduration", "PreRmoderateduration", "PreRvigorousduration",
    "PreRskipbreakfast", "PreRlessfiber", "PreRlessfruit", "PreRlessvegetable",
    "PreRmilk", "PreRmeat", "PreRfriedfood", "PreRpopcorn", "PreRsweet", "PreRdrink",
    "PreRstaplefood", "PreRheight", "PreRweight", "PreRhip", "PreRwaist",
    "PreBLPPBS", "PreBLFBS", "PreBLHBA1C", "PreBLCHOLESTEROL", "PreBLTRIGLYCERIDES",
    "PreRsystolicfirst", "PreRdiastolicfirst", "postblage", "PreRdiaage",
    "Diabetic_Duration", "Duration_Status", "current_smoking", "current_alcohol",
]

NUMERIC_FEATURES = [
    "PostBLAge", "PreRwaist", "PreRBMI", "PreRsystolicfirst", "PreRdiastolicfirst",
    "PreBLPPBS", "PreBLFBS", "PreBLHBA1C", "PreBLCHOLESTEROL", "PreBLTRIGLYCERIDES",
    "Diabetic_Duration", "PreRmildactivityduration", "PreRmoderateduration", "PreRvigorousduration",
]
CATEGORICAL_FEATURES = [
    "PreBLGender", "PreRarea", "PreRmaritalstatus", "PreReducation", "PreRpresentoccupation",
    "PreRdiafather", "PreRdiamother", "PreRdiabrother", "PreRdiasister",
    "current_smoking", "current_alcohol", "PreRsleepquality", "PreRmoderate", "PreRvigorous",
    "PreRskipbreakfast", "PreRlessfruit", "PreRlessvegetable", "PreRmilk", "PreRmeat",
    "PreRfriedfood", "PreRsweet", "PostRgroupname",
]
INTERACTIONS = [
    ("PostRgroupname", "PreBLHBA1C", "group_x_hba1c"),
    ("PostRgroupname", "PreBLFBS", "group_x_fbs"),
    ("PostRgroupname", "PreBLPPBS", "group_x_ppbs"),
]

# columns that the cleaning run fills from the best features
ENRICH_TARGETS = ["Diabetic_Duration(years)", "systolic", "diastolic", "current_smoking", "current_alcohol"]

# integer code -> label
CODEBOOK = {
    "group": {1: "Yoga", 2: "Control"},
    "sex": {1: "Male", 2: "Female"},
    "residence": {1: "Urban", 2: "Rural"},
    "marital": {1: "Married", 2: "Unmarried", 3: "Divorcee/Separated", 4: "Widow/Widower", 5: "Others"},
    "education": {
        1: "No schooling", 2: "Primary", 3: "High school", 4: "Intermediate",
        5: "University", 6: "Univ+", 7: "Others",
    },
    "occupation": {
        1: "Professional", 2: "Clerical", 3: "Self-employed", 4: "Unskilled", 5: "Homemaker",
        6: "Retired", 7: "Unemployed(able)", 8: "Unemployed(unable)", 9: "Others",
    },
    "sleep": {1: "Very good", 2: "Fairly good", 3: "Fairly bad", 4: "Very bad"},
    "activity_frequency": {
        0: "None", 1: "Once/month", 2: "2-3×/month", 3: "Once/week",
        4: "2-3×/week", 5: "4-5×/week", 6: "Every day",
    },
    "activity_duration": {
        0: "None", 1: "≤10 min", 2: "10-30 min", 3: "30min-1hr", 4: "1-1.5hrs", 5: ">1.5hrs",
    },
    "diet": {1: "Usually/Often", 2: "Sometimes", 3: "Rarely/Never"},
    "staple": {1: "Rice", 2: "Ragi", 3: "Wheat", 4: "Bajra", 5: "Jowar", 6: "Maize"},
    "care_plan": {1: "Standard + Yoga", 2: "Standard care"},
}

STRESS_BANDS = [(2, "No to Mild Stress"), (5, "Moderate Stress"), (8, "High Stress"), (10, "Severe Stress")]

# upper edge (exclusive), band, confidence
RISK_BANDS = [
    (5.7, "NORMAL", "High Confidence"),
    (6.5, "PRE_DIABETIC", "Moderate Confidence"),
    (8.0, "DIABETIC", "Moderate Confidence"),
    (None, "HIGH_RISK", "High Confidence"),
]

GLYCAEMIC_NORMAL_BELOW = 5.7
GLYCAEMIC_PRE_UP_TO = 6.4
CATEGORY_ORDER = ["Normoglycemia", "Prediabetes", "Diabetes"]

RESPONSE_CLASSES = [
    (1.0, "Major improvement – Risk reduction achieved"),
    (0.5, "Clinically meaningful improvement"),
    (0.0, "Stabilization / modest improvement"),
    (None, "Non-response"),
]

# field, required, lowest, highest allowed
RECORD_RULES = [
    ("PostBLAge", True, 18, 90),
    ("PreBLGender", True, None, None),
    ("PreRarea", True, 1, 2),
    ("PreRmaritalstatus", True, None, None),
    ("PreReducation", True, None, None),
    ("PreRpresentoccupation", True, None, None),
    ("PreRdiafather", True, 0, 1),
    ("PreRdiamother", True, 0, 1),
    ("PreRdiabrother", True, 0, 1),
    ("PreRdiasister", True, 0, 1),
    ("current_smoking", True, 0, 1),
    ("current_alcohol", True, 0, 1),
    ("PreRsleepquality", True, None, None),
    ("PreRmildactivityduration", True, None, None),
    ("PreRmoderate", True, None, None),
    ("PreRmoderateduration", True, None, None),
    ("PreRvigorous", True, None, None),
    ("PreRvigorousduration", True, None, None),
    ("PreRskipbreakfast", True, None, None),
    ("PreRlessfruit", True, None, None),
    ("PreRlessvegetable", True, None, None),
    ("PreRmilk", True, None, None),
    ("PreRmeat", True, None, None),
    ("PreRfriedfood", True, None, None),
    ("PreRsweet", True, None, None),
    ("PreRwaist", True, 0, None),
    ("PreRBMI", True, 0, 80),
    ("PreRsystolicfirst", True, 0, None),
    ("PreRdiastolicfirst", True, 0, None),
    ("PreBLPPBS", True, 0, None),
    ("PreBLFBS", True, 0, None),
    ("PreBLHBA1C", True, 0, None),
    ("PreBLCHOLESTEROL", True, 0, None),
    ("PreBLTRIGLYCERIDES", True, 0, None),
    ("Diabetic_Duration", True, 0, None),
    ("PostRgroupname", True, 1, 2),
]
FORM_RULES = [
    ("PreBLGender", True, None, None),
    ("PostBLAge", True, 18, 90),
    ("PreRarea", True, None, None),
    ("PreRmaritalstatus", True, None, None),
    ("PreReducation", True, None, None),
    ("PreRpresentoccupation", True, None, None),
    ("PreRsleepquality", True, None, None),
    ("PostRgroupname", True, None, None),
    ("PreRmildactivityduration", True, None, None),
    ("PreRmoderate", True, None, None),
    ("PreRmoderateduration", True, None, None),
    ("PreRvigorous", True, None, None),
    ("PreRvigorousduration", True, None, None),
    ("PreRskipbreakfast", True, None, None),
    ("PreRlessfruit", True, None, None),
    ("PreRlessvegetable", True, None, None),
    ("PreRmilk", True, None, None),
    ("PreRmeat", True, None, None),
    ("PreRfriedfood", True, None, None),
    ("PreRsweet", True, None, None),
    ("PreRwaist", True, 50, 150),
    ("PreRBMI", True, 10, 60),
    ("PreRsystolicfirst", True, 70, 250),
    ("PreRdiastolicfirst", True, 40, 150),
    ("PreBLPPBS", True, 70, 600),
    ("PreBLFBS", True, 50, 400),
    ("PreBLHBA1C", True, 4.0, 18.0),
    ("PreBLCHOLESTEROL", True, 80, 400),
    ("PreBLTRIGLYCERIDES", True, 50, 1000),
    ("Diabetic_Duration", True, 0, 60),
]

# record field types, in record order
RECORD_TYPES = {
    name: "string" if name == "PreBLGender" else "int" if name in (
        "PreRarea", "PreRdiafather", "PreRdiamother", "PreRdiabrother", "PreRdiasister",
        "current_smoking", "current_alcohol", "PostRgroupname",
    ) else "double"
    for name, _, _, _ in RECORD_RULES
}

# feature prefix, comparison, threshold, forbidden direction; the first prefix that fits decides
GUARDRAIL_RULES = [
    ("group_x_", "always", None, "both"),
    ("PreRBMI", ">=", 25, "decrease"),
    ("PreRwaist", ">=", 90, "decrease"),
    ("PreRsystolicfirst", ">=", 130, "decrease"),
    ("PreRdiastolicfirst", ">=", 80, "decrease"),
    ("PreBLCHOLESTEROL", ">=", 200, "decrease"),
    ("PreBLTRIGLYCERIDES", ">=", 150, "decrease"),
    ("PreBLFBS", "always", None, "both"),
    ("PreBLPPBS", "always", None, "both"),
    ("PreBLHBA1C", "always", None, "both"),
    ("PreRdiafather", "yes_no", None, "against"),
    ("PreRdiamother", "yes_no", None, "against"),
    ("PreRdiabrother", "yes_no", None, "against"),
    ("PreRdiasister", "yes_no", None, "against"),
    ("PostBLAge", ">", 60, "decrease"),
]

READABLE_NAMES = {
    "PostBLAge": "Age",
    "PreBLGender": "Gender",
    "PreRarea": "Residential area",
    "PreRmaritalstatus": "Marital status",
    "PreReducation": "Education level",
    "PreRpresentoccupation": "Current occupation",
    "PreRdiafather": "Father's diabetes history",
    "PreRdiamother": "Mother's diabetes history",
    "PreRdiabrother": "Brother's diabetes history",
    "PreRdiasister": "Sister's diabetes history",
    "PreRsleepquality": "Sleep quality",
    "PreRmildactivityduration": "Mild activity duration",
    "PreRmoderate": "Moderate physical activity",
    "PreRmoderateduration": "Moderate activity duration",
    "PreRvigorous": "Vigorous physical activity",
    "PreRvigorousduration": "Vigorous activity duration",
    "PreRskipbreakfast": "Skipping breakfast",
    "PreRlessfruit": "Low fruit intake",
    "PreRlessvegetable": "Low vegetable intake",
    "PreRmilk": "Milk consumption",
    "PreRmeat": "Meat consumption",
    "PreRfriedfood": "Fried food intake",
    "PreRsweet": "Sweet intake",
    "PreRwaist": "Waist circumference",
    "PreRBMI": "Body Mass Index (BMI)",
    "PreRsystolicfirst": "Systolic blood pressure",
    "PreRdiastolicfirst": "Diastolic blood pressure",
    "PreBLPPBS": "Postprandial blood glucose",
    "PreBLFBS": "Fasting blood glucose",
    "PreBLHBA1C": "Baseline HbA1c",
    "PreBLCHOLESTEROL": "Total cholesterol",
    "PreBLTRIGLYCERIDES": "Triglycerides",
    "Diabetic_Duration": "Duration of diabetes (years)",
    "PostRgroupname": "Intervention",
    "current_alcohol": "Alcohol use",
    "current_smoking": "Smoking status",
}

INTENSITY = [(0.3, "significantly"), (0.1, "moderately"), (None, "slightly")]

# scenario id, field, value it applies to, new value, title, description, wording of both values
SCENARIOS = [
    (1, "PostRgroupname", 2, 1, "Join Yoga Intervention",
     "What if you joined the yoga intervention group instead of standard care?", "Standard Care", "Yoga"),
    (2, "PostRgroupname", 1, 2, "Standard Care Only",
     "What if you stopped the yoga intervention and only received standard care?", "Yoga", "Standard Care"),
]

# band, order, title, text
ADVICE = [
    ("HIGH_RISK", 1, "Consult Endocrinologist",
     "With high predicted HbA1c, schedule an appointment with a diabetes specialist for comprehensive evaluation."),
    ("HIGH_RISK", 2, "Monitor Daily",
     "Regular blood glucose monitoring is critical. Track FBS and PPBS daily and maintain a health diary."),
    ("HIGH_RISK", 3, "Medication Review",
     "Discuss medication adjustments with your doctor. Doses may need to be optimized for better control."),
    ("DIABETIC", 1, "Regular Checkups",
     "Schedule HbA1c tests every 3 months to monitor your diabetes management progress."),
    ("DIABETIC", 2, "Lifestyle Changes",
     "Quit smoking, limit alcohol, and maintain consistent sleep patterns for better glucose control."),
    ("PRE_DIABETIC", 1, "Early Action",
     "Pre-diabetic levels can be reversed with lifestyle changes. Act now to prevent progression to diabetes."),
    ("PRE_DIABETIC", 2, "Increase Activity",
     "Aim for 150 minutes of moderate activity per week. Even walking 30 minutes daily helps significantly."),
    ("NORMAL", 1, "Keep It Up!",
     "Your predicted HbA1c is in the normal range. Continue maintaining your healthy lifestyle!"),
    ("NORMAL", 2, "Stay Active",
     "Continue regular physical activity and yoga practice to maintain your excellent glucose control."),
]
# two rows that follow the own rows of every band
ADVICE_FOR_ALL = [
    ("Yoga & Exercise",
     "Regular yoga and moderate exercise can significantly improve insulin sensitivity and lower HbA1c levels."),
    ("Balanced Diet",
     "Focus on low glycemic index foods, whole grains, vegetables, and limit refined sugars and fried foods."),
]

# narrative of one record: section, lines of (label, column, how it is shown, unit or codes)
NARRATIVE_HEAD = "=== PATIENT DIABETES ASSESSMENT DATA ==="
NARRATIVE_FOOT = "========================================"
NARRATIVE_SECTIONS = [
    ("PATIENT PROFILE", [
        ("Age", "PostBLAge", "text", " years"),
        ("Gender", "PreBLGender", "text", ""),
        ("Area", "PreRarea", "code", "residence"),
        ("Marital Status", "PreRmaritalstatus", "text", ""),
        ("Education Level", "PreReducation", "text", ""),
        ("Occupation", "PreRpresentoccupation", "text", ""),
    ]),
    ("FAMILY DIABETES HISTORY", [
        ("Father Diabetic", "PreRdiafather", "yes", ""),
        ("Mother Diabetic", "PreRdiamother", "yes", ""),
        ("Brother Diabetic", "PreRdiabrother", "yes", ""),
        ("Sister Diabetic", "PreRdiasister", "yes", ""),
    ]),
    ("LIFESTYLE", [
        ("Current Smoking", "current_smoking", "yes", ""),
        ("Current Alcohol", "current_alcohol", "yes", ""),
        ("Sleep Quality", "PreRsleepquality", "text", " (1=Good, 4=Poor)"),
    ]),
    ("HEALTH METRICS", [
        ("Waist", "PreRwaist", "text", " cm"),
        ("BMI", "PreRBMI", "text", ""),
        ("Systolic BP", "PreRsystolicfirst", "text", " mmHg"),
        ("Diastolic BP", "PreRdiastolicfirst", "text", " mmHg"),
    ]),
    ("BLOOD WORK", [
        ("Fasting Blood Sugar (FBS)", "PreBLFBS", "text", " mg/dL"),
        ("Post-Prandial Blood Sugar (PPBS)", "PreBLPPBS", "text", " mg/dL"),
        ("Pre-Treatment HbA1c", "PreBLHBA1C", "text", "%"),
        ("Cholesterol", "PreBLCHOLESTEROL", "text", " mg/dL"),
        ("Triglycerides", "PreBLTRIGLYCERIDES", "text", " mg/dL"),
        ("Diabetic Duration", "Diabetic_Duration", "text", " years"),
        ("Intervention Group", "PostRgroupname", "code", "group"),
    ]),
    ("PREDICTED OUTCOME", [
        ("Predicted Post-Treatment HbA1c", "score", "score", "%"),
        ("Risk Level", "risk_band", "score", ""),
        ("Confidence", "confidence", "score", ""),
    ]),
]
NARRATIVE_LISTS = {
    "top": ("TOP CONTRIBUTING FACTORS (SHAP)", "  (None available)"),
    "scenarios": ("WHAT-IF SCENARIOS", "  (None generated)"),
}
NARRATIVE_COMBINED = ("  BEST COMBINED OUTCOME (all changes): HbA1c ", "% (", ")")

# --------------------------------------------------------------------------
# End of fixed values.
# --------------------------------------------------------------------------


def advice_rows():
    """(band, order, title, text) with the common rows appended to each band."""
    rows = list(ADVICE)
    for band in dict.fromkeys(row[0] for row in ADVICE):
        own = sum(1 for row in ADVICE if row[0] == band)
        rows += [(band, own + i, title, text) for i, (title, text) in enumerate(ADVICE_FOR_ALL, 1)]
    return rows
