"""Word lists, patterns and catalogues that decide results and therefore stand here as they are."""

# --- words -------------------------------------------------------------------------------------
# Words that carry no meaning for matching.
STOP_WORDS = (
    "a an and are as at be by for from has have he her his how i in is it its me my of on or our she that the their them they this to was were what when "
    "which who why will with you your does did do patient patients please tell show give about s t"
).split()
# Token -> words that stand for it in matching.
SYNONYMS = {
    "hba1c": "hemoglobin a1c", "a1c": "hemoglobin a1c", "htn": "hypertension", "bp": "blood pressure", "mi": "myocardial infarction", "ckd": "chronic kidney disease",
    "t2dm": "type 2 diabetes", "dm2": "type 2 diabetes", "afib": "atrial fibrillation", "chf": "heart failure", "copd": "chronic obstructive pulmonary disease", "gerd": "reflux",
    "sob": "shortness of breath", "egfr": "egfr kidney function", "ldl": "ldl cholesterol", "nsaid": "nsaids ibuprofen", "nsaids": "nsaids ibuprofen",
    "diagnosis": "condition diagnosis", "diagnoses": "condition diagnoses", "diagnosed": "condition diagnosed", "diganosis": "condition diagnosis", "diganoses": "condition diagnoses",
    "problem": "condition problem", "problems": "condition problems", "illness": "condition illness", "illnesses": "condition illnesses", "visit": "encounter visit",
    "visits": "encounter visits", "appointment": "encounter appointment", "appointments": "encounter appointments", "meds": "medication meds", "medicine": "medication medicine",
    "medicines": "medication medicines", "prescription": "medication prescription", "prescriptions": "medication prescriptions", "drug": "medication drug",
    "drugs": "medication drugs", "regimen": "medication regimen", "present": "present active",
}

# --- catalogues --------------------------------------------------------------------------------
DRUGS = (
    "metformin|empagliflozin|glipizide|sitagliptin|insulin glargine|lisinopril|losartan|amlodipine|hydrochlorothiazide|metoprolol|carvedilol|atorvastatin|"
    "rosuvastatin|simvastatin|furosemide|spironolactone|apixaban|warfarin|clopidogrel|aspirin|levothyroxine|sertraline|escitalopram|buspirone|omeprazole|"
    "pantoprazole|montelukast|albuterol|tiotropium|meloxicam|ibuprofen|alendronate|sumatriptan"
).split("|")
# Lab -> (unit, low, high, other names).
LABS = {
    "hemoglobin a1c": ("%", 4.8, 5.6, "hba1c|a1c|glycated hemoglobin|glycosylated hemoglobin"),
    "fasting glucose": ("mg/dL", 72, 99, "fasting blood sugar|fbs|fasting blood glucose"),
    "ldl cholesterol": ("mg/dL", 70, 129, "ldl|ldl-c|low-density lipoprotein"),
    "total cholesterol": ("mg/dL", 140, 199, "cholesterol"),
    "egfr": ("mL/min/1.73m2", 75, 110, "gfr|estimated glomerular filtration rate|glomerular filtration rate"),
    "creatinine": ("mg/dL", 0.6, 1.2, "serum creatinine|cr"),
    "potassium": ("mmol/L", 3.6, 5.0, "k|serum potassium"),
    "sodium": ("mmol/L", 136, 145, "na|serum sodium"),
    "tsh": ("mIU/L", 0.5, 4.0, "thyroid stimulating hormone|thyrotropin"),
    "hemoglobin": ("g/dL", 12.0, 16.0, "hgb|hb"),
    "inr": ("", 0.9, 1.1, "international normalized ratio|pt/inr"),
    "systolic blood pressure": ("mmHg", 108, 128, "systolic bp|sbp"),
    "diastolic blood pressure": ("mmHg", 66, 82, "diastolic bp|dbp"),
    "bmi": ("kg/m2", 20.5, 26.0, "body mass index"),
    "bnp": ("pg/mL", 10, 95, "b-type natriuretic peptide|brain natriuretic peptide"),
    "urine albumin-creatinine ratio": ("mg/g", 3, 25, "uacr|microalbumin|albumin creatinine ratio"),
}
MORE_LABS = {"blood glucose": "fasting glucose", "glucose": "fasting glucose", "blood pressure": "systolic blood pressure"}
# Condition -> (ICD-10 code, other names).
CONDITIONS = {
    "type 2 diabetes": ("E11.9", "type 2 diabetes mellitus|t2dm|dm2|diabetes|non-insulin dependent diabetes"),
    "type 2 diabetes with hyperglycemia": ("E11.65", "uncontrolled diabetes|poorly controlled diabetes"),
    "type 2 diabetes with diabetic chronic kidney disease": ("E11.22", "diabetic kidney disease|diabetic nephropathy"),
    "hypertension": ("I10", "essential hypertension|high blood pressure|htn"),
    "hyperlipidemia": ("E78.5", "high cholesterol|dyslipidemia|hld"),
    "chronic kidney disease stage 3": ("N18.30", "ckd stage 3|ckd 3|ckd3|chronic kidney disease"),
    "chronic kidney disease stage 4": ("N18.4", "ckd stage 4|ckd 4|ckd4"),
    "asthma": ("J45.909", "bronchial asthma"),
    "copd": ("J44.9", "chronic obstructive pulmonary disease|emphysema|chronic bronchitis"),
    "atrial fibrillation": ("I48.91", "afib|a-fib|af"),
    "heart failure": ("I50.9", "chf|congestive heart failure|hf"),
    "coronary artery disease": ("I25.10", "cad|ischemic heart disease|atherosclerotic heart disease"),
    "old myocardial infarction": ("I25.2", "prior mi|history of myocardial infarction|previous heart attack|old mi"),
    "hypothyroidism": ("E03.9", "underactive thyroid|low thyroid"),
    "major depressive disorder": ("F32.9", "depression|mdd"),
    "generalized anxiety disorder": ("F41.1", "gad|anxiety"),
    "gerd": ("K21.9", "gastroesophageal reflux disease|acid reflux|reflux|heartburn"),
    "knee osteoarthritis": ("M17.9", "osteoarthritis|oa|degenerative joint disease"),
    "obesity": ("E66.9", "obese"),
    "obstructive sleep apnea": ("G47.33", "osa|sleep apnea"),
    "history of stroke": ("Z86.73", "prior stroke|history of cva|old stroke"),
    "osteoporosis": ("M81.0", "age-related osteoporosis|low bone density"),
    "anemia": ("D64.9", "low hemoglobin"),
    "migraine": ("G43.909", "migraine headache|migraines"),
}
MORE_CONDITIONS = {
    "myocardial infarction": "old myocardial infarction", "diabetes": "type 2 diabetes", "chronic kidney disease": "chronic kidney disease",
    "atrial fibrillation": "atrial fibrillation", "stroke": "history of stroke", "osteoarthritis": "knee osteoarthritis",
}

# --- query normalisation: (pattern, replacement, whether case counts), applied in this order ------
REWRITES = (
    (r"\bhb\s?a1c\b|\ba1c\b", "hemoglobin a1c", False), (r"\bglyc(?:osyl)?ated\s+ha?emoglobin\b", "hemoglobin a1c", False),
    (r"\bLDL(?:-C)?\b(?!\s*cholesterol)", "ldl cholesterol", True), (r"\be?GFR\b", "egfr", True), (r"\bUACR\b", "urine albumin-creatinine ratio", True),
    (r"\bSBP\b", "systolic blood pressure", True), (r"\bDBP\b", "diastolic blood pressure", True), (r"\bBP\b", "blood pressure", True), (r"\bK\+", "potassium", True),
    (r"\bCr\b", "creatinine", True), (r"\bblood sugar\b", "blood glucose", False), (r"\bHgb\b|\bHb\b", "hemoglobin", True),
    (r"\bT2DM\b|\bDM2\b|\bT2D\b|\btype\s+(?:2|ii|two)\s+DM\b", "type 2 diabetes", False), (r"\bDM\b", "diabetes", True), (r"\bHTN\b", "hypertension", False),
    (r"\bhigh blood pressure\b", "hypertension", False), (r"\bhyperlipid(?:a)?emia\b|\bHLD\b|\bdyslipid(?:a)?emia\b", "hyperlipidemia", False),
    (r"\bhigh cholesterol\b", "hyperlipidemia", False), (r"\bCKD\b", "chronic kidney disease", False), (r"\bCAD\b", "coronary artery disease", True),
    (r"\bCHF\b", "heart failure", False), (r"\bHF\b", "heart failure", True), (r"\bA-?fib\b|\bAF\b", "atrial fibrillation", False), (r"\bMI\b", "myocardial infarction", True),
    (r"\bheart attack\b", "myocardial infarction", False), (r"\bOA\b", "osteoarthritis", True), (r"\bOSA\b", "obstructive sleep apnea", True),
    (r"\bMDD\b", "major depressive disorder", True), (r"\bGAD\b", "generalized anxiety disorder", True), (r"\bacid reflux\b|\bGORD\b", "gerd", False), (r"\bCVA\b", "stroke", True),
    (r"\bSOB\b", "shortness of breath", True), (r"\bCP\b", "chest pain", True), (r"\bNSAIDs?\b", "nsaids", False), (r"\bACE[- ]?i\b|\bACE inhibitors?\b", "ace inhibitor", False),
    (r"\bARBs?\b", "angiotensin receptor blocker", True), (r"\bSGLT-?2i?\b", "sglt2 inhibitor", False), (r"\bPPIs?\b", "proton pump inhibitor", True), (r"\bSSRIs?\b", "ssri", True),
    (r"\bblood thinners?\b", "anticoagulant", False), (r"\bHx\b", "history", False), (r"\bDx\b", "diagnosis", False), (r"\bmeds\b", "medications", False), (r"\bpt\b", "patient", False),
    (r"\bpatient'?s\b|\bpatients\b", "patient", False), (r"\bdi[ag]{2}nos(?:is|es)?\b|\bdiganos(?:is|es)?\b|\bdiagnoisis\b", "diagnosis", False),
)

# --- query signals -------------------------------------------------------------------------------
PATIENT_ID = r"\b[Pp](\d{4,6})(?:'?s)?\b"
ICD_CODE = r"\b([A-TV-Z]\d[0-9A-Z](?:\.[0-9A-Z]{1,4})?)\b"
ICD_CONTEXT = r"(?i)\b(icd|code|diagnosis code|billing)\b"
RXCUI = r"(?i)\b(?:rx\s*cui|rxnorm|rx\s*norm)\s*(?:id|code|identifier)?\s*[:#]?\s*(\d{2,8})\b"
NEGATION = r"\b(no|not|without|denies|denied|negative for|never|isn't|wasn't|isnt|wasnt|no longer|free of|absence of)\b"
DOSAGE = (
    r"\b(dose|doses|dosed|dosage|dosing|how much|how many (?:mg|milligrams|units)|mg|mcg|milligram|units?|maximum|max(?:imum)? daily|titrat\w*|strength|tablets?)\b"
)
RECORD_TYPES = {
    "medications": r"\b(medications?|medicines?|prescriptions?|prescribed|taking|on any|what (?:is|are) (?:she|he|they) on|drug list|med list)\b",
    "allergies": r"\b(allerg\w*|reactions? to)\b",
    "labs": r"\b(labs?|lab results?|bloodwork|blood work|test results?)\b",
    "conditions": r"\b(conditions?|di[ag]{1,2}nos[ie]s|problem list|problems|comorbidit\w+|medical history|chronic illness\w*)\b",
    "encounters": r"\b(visits?|encounters?|appointments?|seen (?:last|in))\b",
    "demographics": r"\b(age|how old|date of birth|dob|born|sex|gender|demographics?)\b",
}
NUMBER_WORDS = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "twelve": 12, "eighteen": 18, "twenty-four": 24}
UNIT_DAYS = {"day": 1, "week": 7, "month": 30, "year": 365}
RELATIVE = r"\b(?:last|past|previous|within the last)\s+(\d+|one|two|three|four|five|six|twelve|eighteen|twenty-four)?\s*(day|week|month|year)s?\b"
KNOWLEDGE = (
    r"\b(side effects?|adverse (?:effects?|reactions?)|contraindicat\w*|warnings?|precautions?|interact\w*|guidance|guidelines?|recommend\w*|label|indicat\w*|why|explain|"
    r"how does|how do|how is|what causes|causes? of|symptoms? of|signs? of|risk factors?|treat(?:ed|ment|ments)?|prevent\w*|manage\w*|mechanism|safe|safety|appropriate|should|"
    r"consistent with|in line with|according to|monitor\w*|avoid|lifestyle|what (?:is|are) (?:a |an |the )?(?:normal|target|goal)|what does .* (?:mean|do)|used for|overview of|"
    r"learn about|counsel\w*)\b"
)
NARRATIVE = (
    r"\b(notes?|documented|mention\w*|report\w*|complain\w*|describ\w*|said|says|narrative|history of present illness|hpi|assessment|plan|visit summary|summari[sz]e|"
    r"symptoms? (?:did|has|have)|experienc\w*|noticed|felt|feeling|cough\w*|swelling|pain|bruis\w*|aches?|tingling|tolerat\w*|why (?:was|did)|reason)\b"
)
LOOKUP = (
    r"\b(what is the (?:latest|most recent|current|last)|latest|most recent|current|list|show|value|level|reading|result|when (?:was|did)|how many|code for|icd|rxcui|rxnorm|"
    r"identifier|brand names?|is .* on|taking|prescribed|dose of|dosage of|what dose|stopped|discontinued|started|switched|changed|allergic)\b"
)
DEFINITION = r"\b(what does .* (?:mean|stand for)|meaning of|definition|describe (?:the )?code|what is (?:icd|code))\b"
IDENTIFIER = r"\b(rxcui|rxnorm|identifier|brand names?|generic name)\b"
NOTES_ONLY = r"\b(notes?|documented|report\w*|complain\w*|said|mention\w*|visit|hpi|history of present illness)\b"
DRUG_WORDS = r"\b(side effects?|adverse|dose|dosage|dosing|label|interact\w*|contraindicat\w*|warnings?|medication|drug|tablet|pill|overdos\w*)\b"

# --- safety ----------------------------------------------------------------------------------------
_CHEST = r"(?:chest (?:pain|pressure|tightness|discomfort)|pain in (?:my|the|his|her) chest|chest (?:hurts|is hurting|feels tight))[^.?!]{0,60}"
RED_FLAGS = {
    "cardiac": (
        _CHEST + r"(?:radiat\w*|spread\w*|going|moving|shoot\w*) (?:down |up |in)?(?:to |into )?(?:my |the |his |her )?(?:left |right )?(?:arm|jaw|neck|back|shoulder)",
        _CHEST + r"(?:sweat\w*|short(?:ness)? of breath|can'?t breathe|faint\w*|nause\w*|vomit\w*)",
        r"crushing (?:chest )?(?:pain|pressure)", r"(?:having|think i'?m having|is having) a (?:heart attack|myocardial infarction)",
    ),
    "stroke": (
        r"face (?:is )?droop\w*|droop\w* face", r"slurr\w* (?:speech|words)|can'?t (?:speak|talk) (?:properly|clearly)|sudden(?:ly)? (?:can'?t|cannot) (?:speak|talk)",
        r"sudden\w* (?:weakness|numbness)[^.?!]{0,40}(?:one side|left side|right side|arm|leg|face)",
        r"(?:can'?t|cannot) (?:move|lift|feel) (?:my |his |her )?(?:left|right|one) (?:arm|leg|side)", r"worst headache of (?:my|his|her|their) life",
        r"(?:having|is having) a stroke", r"sudden(?:ly)? (?:lost|loss of) (?:vision|sight)",
    ),
    "self_harm": (
        r"suicid\w*", r"kill (?:my ?self|himself|herself|themselves)", r"end(?:ing)? (?:my|his|her|their) (?:own )?life",
        r"(?:don'?t|do not|can'?t) see (?:the|any) point (?:anymore|any more|in living|of living|in going on)", r"better off (?:dead|without me)", r"(?:want|wants|going) to die",
        r"self[- ]?harm\w*|hurt (?:my ?self|himself|herself)|cut(?:ting)? (?:my ?self|myself)", r"no reason to (?:live|go on)",
    ),
    "overdose": (
        r"overdos\w*", r"took (?:too many|a (?:whole )?bottle of|an entire bottle of|\d{2,} )(?:pills|tablets|capsules)?",
        r"(?:took|injected|gave (?:myself|him|her)) (?:a bunch of|too much|way too much|extra|double|an extra|twice (?:my|the))\s+(?:\w+\s+){0,2}"
        r"(?:insulin|pills?|tablets?|doses?|medicines?|medications?|units)",
        r"swallowed (?:a (?:whole )?bottle|too many|all (?:my|the|of))", r"poison\w*",
    ),
    "anaphylaxis": (r"throat (?:is )?(?:closing|swelling|tight\w*)", r"(?:tongue|lips?) (?:is |are )?swell\w*[^.?!]{0,30}(?:breath|swallow)", r"anaphyla\w*"),
    "breathing": (r"(?:can'?t|cannot|unable to|struggling to|hard to) breathe", r"(?:lips|face) (?:are |is |turning )?(?:blue|grey|gray)", r"not breathing|stopped breathing|chok\w+"),
    "bleeding": (r"(?:won'?t|will not|doesn'?t|does not) stop bleeding|bleeding (?:heavily|a lot|won'?t stop)", r"(?:vomit\w*|cough\w*|throw\w* up) (?:up )?blood"),
    "unresponsive": (r"unconscious|unresponsive|won'?t wake up|passed out and", r"(?:having|is having) a seizure|seizing"),
}
FIRST_PERSON = r"\b(i|i'm|im|i am|i've|my|me|we|we're|our)\b"
URGENT = r"\b(right now|now|currently|just (?:took|started|happened)|suddenly|at the moment|tonight|today|help)\b"
RECORD_FRAME = (
    r"\b(history of|hx of|documented|notes?|records?|chart|report(?:ed|s)?|did (?:p\d{4,6}|the patient|patients?|he|she|they)|has (?:p\d{4,6}|the patient|patients?|he|she|they) "
    r"(?:ever|had|been)|any (?:mention|episodes?|record)|previous(?:ly)?|prior|past|screen(?:ing|ed)? for|risk (?:of|for)|assessment)\b|\bp\d{4,6}\b"
)
MEDICAL_HINT = (
    r"\b(patient\w*|p\d{4,6}|medic\w*|meds|drug|warnings?|boxed|adverse|contraindicat\w*|interact\w*|prescri\w*|dose|dosage|tablet|pill|label|lab|test|result|blood|heart|kidney|liver|"
    r"lung|diabet\w*|pressure|cholesterol|thyroid|asthma|copd|pain|symptom\w*|side effect\w*|di[ag]{1,2}nos\w*|condition\w*|disease|treat\w*|therap\w*|allerg\w*|icd|rxcui|rxnorm|code|"
    r"health|clinical|clinic|doctor|nurse|hospital|infection|fever|cough|rash|headache|migraine|stroke|weight|bmi|glucose|a1c|egfr|creatinine|insulin|statin|note|notes|visit|encounter|"
    r"history|depress\w*|anxiety|sleep|bone|anemi\w*|reflux|vaccine|surgery|ldl|tsh|inr|bnp|potassium|sodium|hemoglobin|arthritis|obes\w*|apnea|fibrillation|failure|hypertension|"
    r"pregnan\w*|breast|alcohol|smok\w*|exercise|diet|nutrition)\b"
)
PATIENT_REFERENCE = r"\b(she|he|her|his|him|they|their|them|patients?|patient'?s|patients'|this patient|pts?|p\d{4,6})\b"

# --- answers -----------------------------------------------------------------------------------------
EXEMPT = (
    r"(not medical advice|educational|consult|clinician|healthcare (?:provider|professional)|pharmacist|doctor|information consistent with|based on the retrieved|"
    r"the retrieved (?:sources|records|evidence)|cannot (?:provide|determine|confirm)|does not replace|i don't have enough information|"
    r"not (?:stated|mentioned|documented) in the (?:sources|records|evidence))"
)
QUESTION_NOISE = "what which latest recent current present list show tell know any there all active".split()
RECORD_KIND_TERMS = {
    "condition": "condition diagnosi problem illness hx histor", "medication": "medication drug med meds prescript prescrib take taking regimen",
    "lab": "lab test result reading value level bloodwork", "encounter": "encounter visit appointment seen", "allergy": "allergi allergy allergic reaction",
    "demographics": "demograph age sex dob birth",
}
OPENING = "Based on the retrieved sources, here is information consistent with your question."
INSUFFICIENT = "INSUFFICIENT_EVIDENCE"
ABSTAIN = "The retrieved sources do not support an answer."
DOSE = r"(\d+(?:\.\d+)?)\s*(mg|mcg|units?)\b"

# --- salt and hydrate words of drug names, which do not count when names are compared ----------------
SALTS = (
    "hydrochloride", "hcl", "sodium", "potassium", "calcium", "besylate", "succinate", "tartrate", "sulfate", "maleate", "mesylate", "bromide", "propionate", "magnesium", "monohydrate", "dihydrate", "anhydrous",
    "hyclate", "citrate", "fumarate",
)
