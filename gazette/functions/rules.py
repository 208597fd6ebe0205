"""Rule vocabularies.

FIXED VALUES: every list below must equal the notice-publishing tool's own
lists for results to match, so they are written out plainly, in their
original order. Patterns use PCRE spelling (``\\b`` word boundary, ``.`` not
matching a newline); ``gazette.functions.regex`` turns them into the Java and
RE2 dialects.
"""

# --- registrable domain: second-level suffixes that keep three labels ---
SECOND_LEVEL_SUFFIXES = [
    "gov.in", "nic.in", "ac.in", "edu.in", "org.in", "co.in", "res.in", "net.in",
]

# --- job-board / aggregator domains (a host equal to or under one is "aggregator").
# The publishing site's own host is appended at run time from ``SiteConfig.host``. ---
AGGREGATOR_DOMAINS = [
    "sarkarijobfind.com", "freejobalert.com", "sarkariresult.com", "rojgarresult.com",
    "naukri.com", "indeed.com", "shine.com", "monsterindia.com", "timesjobs.com",
    "sarkariexam.com", "sarkariresults.in", "sarkarinaukri.com", "govtjobsalert.in",
    "sarkariwallahs.com", "govtjobguru.com", "sarkarialert.com", "govresult.com",
    "indgovtjobs.in", "govtjobs.com", "allindiajobs.in", "newgovtjobs.in",
    "freshersworld.com", "careerpower.in", "adda247.com", "testbook.com", "oliveboard.in",
    "jagranjosh.com", "aglasem.com", "successcds.net", "examresults.net", "resultnic.in",
    "careerwill.com", "gradeup.co", "byjus.com", "unacademy.com", "vidyakul.com",
    "rajasthanvacancy.com", "rajasthanhelp.com", "sarkarinaukrihelp.com",
    "govtjobadda.com", "latestjobs.in", "naukrimessenger.com",
]

# --- official host patterns (case-insensitive; the first six are anchored at the end) ---
OFFICIAL_HOST_PATTERNS = [
    r"\.gov\.in$", r"\.nic\.in$", r"\.ac\.in$", r"\.edu\.in$", r"\.org\.in$", r"\.res\.in$",
    r"ssc\.nic\.in", r"upsc\.gov\.in", r"ibps\.in", r"rbi\.org\.in", r"indianrailways\.gov\.in",
    r"indianarmy\.nic\.in", r"indiannavy\.nic\.in", r"indianairforce\.nic\.in", r"bsf\.gov\.in",
    r"crpf\.gov\.in", r"cisf\.gov\.in", r"itbp\.gov\.in", r"ssb\.nic\.in", r"niacl\.org\.in",
    r"licindia\.in", r"onlinesbi\.sbi", r"sbi\.co\.in", r"bankofbaroda\.in", r"pnbindia\.in",
    r"canarabank\.com", r"unionbankofindia\.co\.in", r"centralbankofindia\.co\.in",
    r"bankofindia\.co\.in", r"bankofmaharashtra\.in", r"ucobank\.com", r"npcil\.nic\.in",
    r"barc\.gov\.in", r"drdo\.gov\.in", r"isro\.gov\.in", r"sail\.co\.in", r"hal-india\.co\.in",
    r"bhel\.com", r"ongc\.co\.in", r"iocl\.com", r"gail\.com", r"coalindia\.in", r"ntpc\.co\.in",
    r"powergrid\.in", r"rvnl\.org", r"esic\.nic\.in", r"epfindia\.gov\.in", r"mea\.gov\.in",
    r"aai\.aero", r"ugc\.ac\.in", r"nta\.ac\.in", r"cbse\.gov\.in", r"icai\.org", r"icsi\.edu",
    r"icmai\.in", r"india\.gov\.in",
]

# --- notice type detection: keyword groups in priority order ---
TYPE_KEYWORDS = [
    ("admit_card", ["admit card", "admit-card", "admitcard", "hall ticket", "hall-ticket",
                    "call letter", "download admit", "admit card download"]),
    ("answer_key", ["answer key", "answer-key", "answerkey", "answer sheet", "official key",
                    "provisional key", "final key"]),
    ("syllabus", ["syllabus", "exam pattern", "curriculum", "exam syllabus", "download syllabus"]),
    ("result", ["result", "merit list", "cutoff", "cut-off", "final result", "scorecard",
                "result declared", "check result"]),
]
# The last keyword group (recruitment, vacancy, ...) returns the default "job", so it is not listed.
TYPE_DEFAULT = "job"

# --- link titles, server profile ---
GENERIC_TITLE_SERVER = r"^(link|click here|here|view|open|download|visit|check|more|read|notification|important|official)$"
LINK_TITLE_RULES_SERVER = [
    (r"re.?register|re.?apply", "Re-Apply / Re-Register"),
    (r"apply|register|application|online.form|fill.form", "Apply Online"),
    (r"admit|hall.?ticket|call.?letter|e.?admit", "Download Admit Card"),
    (r"final.result|merit.?list|selection.?list", "Final Result / Merit List"),
    (r"provisional.result", "Provisional Result"),
    (r"scorecard|score.?card", "Download Scorecard"),
    (r"result", "Check Result"),
    (r"answer.?key|ans.?key|solution|objection", "Answer Key"),
    (r"syllabus|curriculum|exam.?pattern", "Download Syllabus"),
    (r"interview|document.?verif|dv.?schedule", "Interview / DV Schedule"),
    (r"walk.?in", "Walk-In Interview Details"),
    (r"cut.?off|cutoff", "Cut-Off Marks"),
    (r"extension|extend", "Extended Last Date Notice"),
    (r"notification|advt|advertisement|circular|corrigendum", "Official Notification PDF"),
    (r"login|candidate.?portal|applicant", "Candidate Login Portal"),
    (r"fee|payment|challan", "Fee / Payment Link"),
    (r"status", "Check Application Status"),
    (r"\.pdf", "Download PDF"),
    (r"\.gov\.|\.nic\.|official|home", "Official Website"),
]
LINK_TITLE_FALLBACK_SERVER = "Official Link "

# --- link titles, client profile ---
GENERIC_TITLE_CLIENT = r"^(link|click here|here|view|open)$"
LINK_TITLE_RULES_CLIENT = [
    (r"notification|advt|advertisement|circular", "Official Notification PDF"),
    (r"apply|register|application|form", "Apply Online"),
    (r"admit|hallticket|hall.ticket|call.letter", "Download Admit Card"),
    (r"result|merit|selected|final.list", "Check Result"),
    (r"syllabus|curriculum|pattern", "Download Syllabus"),
    (r"answer.?key|ans.?key|solution", "Answer Key"),
    (r"scorecard|score.card|marks", "View Scorecard"),
    (r"official|home|\.gov\.|\.nic\.", "Official Website"),
    (r"\.pdf", "Download PDF"),
]
LINK_TITLE_FALLBACK_CLIENT = "Important Link "

# --- link titles, links-table profile (substring tests on the lower url) ---
LINK_TITLE_RULES_TABLE = [
    (".pdf", "Official Notification PDF"),
    ("apply", "Apply Online"),
    ("register", "Register Now"),
    ("admit", "Download Admit Card"),
    ("result", "Check Result"),
    ("syllabus", "Download Syllabus"),
    ("answer", "Answer Key"),
    ("t.me", "\U0001F4E2 Telegram Channel"),
    ("whatsapp.com", "\U0001F7E2 WhatsApp Channel"),
]
LINK_TITLE_FALLBACK_TABLE = "Official Link "

# --- link kind: first keyword contained in the lower title (kind codes stand in for icons) ---
LINK_KIND_KEYWORDS = [
    ("apply online", "apply"), ("register", "apply"), ("application form", "apply"),
    ("admit card", "admit"), ("hall ticket", "admit"), ("call letter", "admit"),
    ("final result", "final_result"), ("merit list", "final_result"), ("selection list", "final_result"),
    ("provisional result", "score"), ("scorecard", "score"), ("marks", "score"), ("result", "score"),
    ("syllabus", "syllabus"), ("exam pattern", "syllabus"),
    ("answer key", "answer_key"),
    ("cut-off", "cutoff"), ("cut off", "cutoff"), ("cutoff", "cutoff"),
    ("interview", "interview"), ("walk-in", "interview"), ("walk in", "interview"),
    ("official website", "official"), ("official", "official"),
    ("notification", "document"), ("pdf", "document"),
    ("telegram", "channel"), ("whatsapp", "channel"), ("channel", "channel"),
    ("schedule", "date"), ("date", "date"), ("extension", "date"),
    ("fee", "payment"), ("payment", "payment"),
    ("login", "lookup"), ("status", "lookup"),
    ("download", "download"),
]
LINK_KIND_DEFAULT = "link"
# client variant: regex tests on the lower title
LINK_KIND_RULES_CLIENT = [
    (r"apply|register", "apply"), (r"admit|hall", "admit"), (r"result|merit", "score"),
    (r"syllabus", "syllabus"), (r"answer", "answer_key"), (r"notification|pdf", "document"),
    (r"official|website", "official"), (r"interview", "interview"),
]

# --- education detection (applied to lower-cased text, in this order) ---
EDUCATION_RULES = [
    ("phd", r"ph\.?d\b|doctorate|doctoral"),
    ("mba", r"\bmba\b|pgdm|post.?graduate.?diploma.?manage"),
    ("llm", r"\bllm\b|master.?of.?law"),
    ("llb", r"\bllb\b|bachelor.?of.?law|law.?graduate"),
    ("mbbs", r"\bmbbs\b|bachelor.?of.?medicine"),
    ("mtech", r"\bm\.?tech\b|\bm\.?e\.\b|master.?of.?technology"),
    ("mpharm", r"\bm\.?pharm\b"),
    ("bpharm", r"\bb\.?pharm\b"),
    ("msc", r"\bm\.?sc\b|master.?of.?science"),
    ("mcom", r"\bm\.?com\b|master.?of.?commerce"),
    ("ma", r"\bm\.?a\.\b|master.?of.?arts"),
    ("ca", r"chartered.?accountant|\bca\b"),
    ("cs", r"company.?secretary|\bcs\b"),
    ("cma", r"\bcma\b|cost.?accountant"),
    ("post_graduate", r"post.?graduate|master.?degree|\bm\.?sc\b|\bm\.?com\b|\bm\.?a\.\b|\bmca\b"),
    ("btech", r"\bb\.?tech\b|\bb\.?e\.\b|bachelor.?of.?engineering|bachelor.?of.?technology"),
    ("bsc", r"\bb\.?sc\b|bachelor.?of.?science"),
    ("bcom", r"\bb\.?com\b|bachelor.?of.?commerce"),
    ("ba", r"\bb\.?a\.\b|bachelor.?of.?arts"),
    ("bed", r"\bb\.?ed\b|bachelor.?of.?education"),
    ("nursing", r"\bnursing\b|\bgnm\b|\bbnsc\b"),
    ("graduate", r"\bgraduate\b|graduation|bachelor.?degree|degree.?holder"),
    ("diploma", r"\bdiploma\b"),
    ("iti", r"\biti\b|industrial.?training.?institute"),
    ("12th_pass", r"12th|hsc|higher.?secondary|intermediate|10\+2"),
    ("10th_pass", r"10th|ssc|matriculation|\bssle\b|secondary.?school"),
]
EDUCATION_MASTERS = ["mba", "mtech", "mpharm", "llm", "msc", "mcom", "ma", "post_graduate"]
EDUCATION_BACHELORS = ["btech", "bsc", "bcom", "ba", "bpharm", "bed", "nursing"]
# case-insensitive test on the original (not lower-cased) text
EDUCATION_DEGREE_WORDS = r"\b(bachelor|graduate|graduation|degree)\b"
EDUCATION_DEFAULT = "graduate"

# --- tag detection (lower-cased text, in this order) ---
TAG_RULES = [
    ("cutoff", r"cut.?off|cutoff"),
    ("merit_list", r"merit.?list"),
    ("selection_list", r"selection.?list"),
    ("final_result", r"final.?result"),
    ("provisional_result", r"provisional.?result"),
    ("revised_result", r"revised.?result"),
    ("scorecard", r"scorecard|score.?card"),
    ("marks", r"marks.?(released|published|available)"),
    ("admit_card", r"admit.?card|hall.?ticket|call.?letter"),
    ("exam_date", r"exam.?date|cbt.?date|test.?date|schedule"),
    ("answer_key", r"answer.?key|response.?sheet|objection"),
    ("syllabus", r"syllabus|exam.?pattern|curriculum"),
    ("new_vacancy", r"recruitment|vacanc(?:y|ies)|notification|advertisement|advt"),
    ("govt_job", r"government.?job|govt\.?\s?job|sarkari.?naukri|bharti"),
    ("link_working", r"link.?working|link.?active|download.?link.?active|apply.?link.?active"),
    ("application_start", r"online.?form.?start|application.?start(?:ed)?|registration.?start(?:ed)?|apply.?online.?start"),
    ("date_extended", r"date.?extended|last.?date.?extended|extended.?till|deadline.?extended|extension.?notice"),
    ("application_reopen", r"re.?open|reopen|re.?opened|re.?registration|application.?reopen"),
]

# --- update signals (lower-cased title + summary + content + source) ---
SIGNAL_RULES = [
    ("date_extended", r"date.?extended|last.?date.?extended|extended.?till|deadline.?extended|extension.?notice"),
    ("application_reopen", r"re.?open|reopen|re.?opened|re.?registration|application.?reopen"),
    ("application_start", r"online.?form.?start|application.?start(?:ed)?|registration.?start(?:ed)?|apply.?online.?start"),
    ("link_working", r"link.?working|link.?active|download.?link.?active|apply.?link.?active"),
    ("exam_date", r"exam.?date|cbt.?date|test.?date|exam.?city|city.?intimation"),
]
SIGNAL_TYPE_TAG = [
    ("admit_card", "admit_card"), ("answer_key", "answer_key"), ("syllabus", "syllabus"),
    ("result", "final_result"), ("job", "govt_job"),
]

# --- default tags at publish, by type (job and unknown types get the first list) ---
DEFAULT_TAGS_BY_TYPE = [
    ("admit_card", ["admit_card"]), ("result", ["final_result"]),
    ("answer_key", ["answer_key"]), ("syllabus", ["syllabus"]),
]
DEFAULT_TAGS_OTHER = ["govt_job", "new_vacancy"]

# --- category correction ---
PSU_WORDS = [
    "iffco", "bpcl", "hpcl", "iocl", "ongc", "gail", "ntpc", "bhel", "sail", "hal", "drdo",
    "isro", "barc", "npcil", "coalindia", "coal india", "power grid", "powergrid", "rvnl",
    "aai", "concor", "rites", "ircon", "irctc", "nhpc", "nlc", "mecl", "bsnl", "mtnl", "nhai",
    "hecl", "beml", "public sector undertaking", "central public sector", "psu",
]
CENTRAL_WORDS = [
    "ministry of", "department of", "government of india", "high court", "supreme court",
    "upsc", "staff selection", "rrb ", "rail", "ibps", "reserve bank", "rbi ", "esic", "epfo",
    "central government", "union government",
]
PSU_CATEGORY = "PSU Jobs"
STATE_CATEGORY = "State Govt Jobs"
CENTRAL_CATEGORY = "Central Govt Jobs"
ALL_INDIA = "All India"

# --- category name -> id aliases ---
CATEGORY_IDS = [
    ("Banking", 1), ("Banking Jobs", 1), ("Railways", 2), ("Railway Jobs", 2), ("SSC", 3),
    ("SSC Jobs", 3), ("UPSC", 4), ("UPSC Jobs", 4), ("State PSC", 5), ("State PSC Jobs", 5),
    ("Defence", 6), ("Defence Jobs", 6), ("State Govt", 7), ("State Govt Jobs", 7),
    ("Police", 8), ("Police Jobs", 8), ("SSB", 9), ("SSB Jobs", 9), ("Central PSU", 12),
    ("PSU Jobs", 12), ("Central Govt Jobs", 14), ("Central Government", 14),
    ("Central University", 15), ("University Jobs", 15), ("Armed Forces", 16),
    ("Armed Forces Jobs", 16), ("Paramilitary", 17), ("Paramilitary Jobs", 17),
    ("Apprentice/Trainee", 18), ("Apprentice Jobs", 18),
]
CATEGORY_DEFAULT_ID = 14
TYPE_CATEGORY = [
    ("admit_card", "Admit Card"), ("result", "Result"), ("answer_key", "Answer Key"),
    ("syllabus", "Syllabus"), ("scholarship", "Scholarship"), ("blog", "Blog"),
]

# --- selection-list dimensions used when the live lists are empty ---
FALLBACK_CATEGORIES = [
    (1, "Central Govt Jobs"), (2, "State Govt Jobs"), (3, "Banking Jobs"), (4, "Railway Jobs"),
    (5, "Teaching Jobs"), (6, "Police / Defence"), (7, "Engineering Jobs"), (8, "Medical / Health"),
    (9, "SSC Jobs"), (10, "UPSC Jobs"), (11, "PSC Jobs"), (12, "Court / Legal"),
    (13, "Scholarship"), (14, "Admit Card"), (15, "Result"), (16, "Answer Key"), (17, "Syllabus"),
]
FALLBACK_STATES = [
    (0, "All India"), (1, "Andhra Pradesh"), (2, "Arunachal Pradesh"), (3, "Assam"), (4, "Bihar"),
    (5, "Chhattisgarh"), (6, "Goa"), (7, "Gujarat"), (8, "Haryana"), (9, "Himachal Pradesh"),
    (10, "Jharkhand"), (11, "Karnataka"), (12, "Kerala"), (13, "Madhya Pradesh"),
    (14, "Maharashtra"), (15, "Manipur"), (16, "Meghalaya"), (17, "Mizoram"), (18, "Nagaland"),
    (19, "Odisha"), (20, "Punjab"), (21, "Rajasthan"), (22, "Sikkim"), (23, "Tamil Nadu"),
    (24, "Telangana"), (25, "Tripura"), (26, "Uttar Pradesh"), (27, "Uttarakhand"),
    (28, "West Bengal"), (29, "Delhi"), (30, "Jammu & Kashmir"), (31, "Ladakh"),
]

# --- organisation abbreviations ---
ORG_ABBREVIATIONS = [
    ("SSC", "Staff Selection Commission"), ("UPSC", "Union Public Service Commission"),
    ("RRB", "Railway Recruitment Board"), ("IBPS", "Institute of Banking Personnel Selection"),
    ("SBI", "State Bank of India"), ("RBI", "Reserve Bank of India"),
    ("ESIC", "Employees State Insurance Corporation"),
    ("EPFO", "Employees Provident Fund Organisation"), ("NHB", "National Housing Bank"),
    ("SSB", "Services Selection Board"), ("DRDO", "Defence Research and Development Organisation"),
    ("ISRO", "Indian Space Research Organisation"), ("BARC", "Bhabha Atomic Research Centre"),
    ("CRPF", "Central Reserve Police Force"), ("BSF", "Border Security Force"),
    ("CISF", "Central Industrial Security Force"), ("ITBP", "Indo-Tibetan Border Police"),
    ("SSF", "Secretariat Security Force"), ("NTPC", "National Thermal Power Corporation"),
    ("BHEL", "Bharat Heavy Electricals Limited"), ("ONGC", "Oil and Natural Gas Corporation"),
    ("BPCL", "Bharat Petroleum Corporation Limited"), ("IOCL", "Indian Oil Corporation Limited"),
    ("HAL", "Hindustan Aeronautics Limited"), ("AAI", "Airports Authority of India"),
    ("NHAI", "National Highways Authority of India"),
]
ORG_CUT_PATTERN = r"\s*(recruitment|vacancy|vacancies|bharti|jobs?|notification|apply|online|posts?|hiring|\d{4}|–|-).*"
ORG_DEFAULT = "Government of India"

# --- slug ---
SLUG_FILLERS = [
    "apply-for", "apply-now", "apply", "notification", "check-here", "recruitment", "jobs",
    "post", "posts", "official", "latest", "new",
]
SLUG_ORG_DEFAULT = "govt"
SLUG_MAX_BYTES = 70

# Date spellings, tried in order against the trimmed lower-case text without a leading weekday:
# (pattern, group of the year, of the month, of the day).  Dashes and dots put the day first when
# the year is last, slashes the month.  A month group may hold a number or an English name.
_MONTH = ("(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|"
          "oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)")
_TIME = (r"(?:(?:t| *,? *(?:at )?)[0-9]{1,2}(?::[0-9]{2}){0,2}(?:\.[0-9]+)? *(?:am|pm|a\.m\.|p\.m\.)?"
         r" *(?:z|utc|gmt|ist|[+-][0-9]{2}:?[0-9]{2})?)?$")
WEEKDAY_RX = r"^(?:mon|tues?|wed(?:nes)?|thu(?:rs)?|fri|sat(?:ur)?|sun)(?:day)?\.?,? +"
DATE_FORMS = [
    (r"^([0-9]{4})[-/.]([0-9]{1,2})[-/.]([0-9]{1,2})" + _TIME, 1, 2, 3),
    (r"^([0-9]{1,2})[-.]([0-9]{1,2})[-.]([0-9]{4})" + _TIME, 3, 2, 1),
    (r"^([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})" + _TIME, 3, 1, 2),
    (r"^([0-9]{1,2})(?:st|nd|rd|th)?[ .-]*" + _MONTH + r"[ .,-]*([0-9]{4})" + _TIME, 3, 2, 1),
    ("^" + _MONTH + r"[ .-]*([0-9]{1,2})(?:st|nd|rd|th)?(?:,| ) *([0-9]{4})" + _TIME, 3, 1, 2),
    (r"^([0-9]{4})[ .-]*" + _MONTH + r"[ .-]*([0-9]{1,2})" + _TIME, 1, 2, 3),
    (r"^([0-9]{4})([0-9]{2})([0-9]{2})(?:t[0-9]{2}:?[0-9]{2}(?::?[0-9]{2})?)?$", 1, 2, 3),
]
MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"

# --- education code -> credential level ---
CREDENTIAL_LEVELS = [
    ("10th_pass", "high school"), ("12th_pass", "high school"), ("graduate", "bachelor degree"),
    ("post_graduate", "master degree"), ("diploma", "associate degree"),
    ("iti", "associate degree"), ("btech", "bachelor degree"), ("bsc", "bachelor degree"),
    ("bcom", "bachelor degree"), ("ba", "bachelor degree"), ("bpharm", "bachelor degree"),
    ("bed", "bachelor degree"), ("nursing", "bachelor degree"), ("llb", "bachelor degree"),
    ("mbbs", "bachelor degree"), ("bds", "bachelor degree"), ("mtech", "master degree"),
    ("msc", "master degree"), ("mcom", "master degree"), ("ma", "master degree"),
    ("mpharm", "master degree"), ("mba", "master degree"), ("llm", "master degree"),
    ("ca", "professional certificate"), ("cs", "professional certificate"),
    ("cma", "professional certificate"), ("phd", "doctoral degree"),
    ("any_qualification", "bachelor degree"),
]

# --- short education labels on the summary card ---
EDUCATION_SHORT_LABELS = [
    ("10th_pass", "10th"), ("12th_pass", "12th"), ("graduate", "Graduate"),
    ("post_graduate", "PG"), ("diploma", "Diploma"), ("iti", "ITI"), ("btech", "B.Tech"),
    ("mtech", "M.Tech"), ("mbbs", "MBBS"), ("any_qualification", "Any"),
]

# --- chip vocabularies ---
VOCAB_TAGS = [
    "cutoff", "merit_list", "selection_list", "final_result", "provisional_result",
    "revised_result", "scorecard", "marks", "admit_card", "exam_date", "answer_key",
    "syllabus", "new_vacancy", "govt_job", "link_working", "application_start",
    "date_extended", "application_reopen",
]
VOCAB_EDUCATION = [
    "10th_pass", "12th_pass", "graduate", "post_graduate", "diploma", "iti", "btech", "mtech",
    "bsc", "msc", "bcom", "mcom", "ba", "ma", "bba", "mba", "ca", "cs", "cma", "llb", "llm",
    "mbbs", "bds", "bpharm", "mpharm", "nursing", "bed", "med", "phd", "any_qualification",
]

POSTING_TYPES = ["job", "admit_card", "result", "answer_key", "syllabus", "blog", "scholarship"]

# --- related-page paths per posting type (label text keeps the source's year) ---
RELATED_LINKS = [
    ("job", [("/jobs", "Latest Govt Jobs 2026"), ("/category/ssc", "SSC Jobs 2026"),
             ("/category/upsc", "UPSC Jobs 2026"), ("/category/banking", "Banking Jobs 2026"),
             ("/category/railways", "Railway Jobs 2026"), ("/admit-cards", "Download Admit Card"),
             ("/results", "Check Latest Results"), ("/syllabus", "Download Syllabus PDF"),
             ("/category/state-govt", "State Govt Jobs 2026"), ("/category/defence", "Defence Jobs 2026")]),
    ("admit_card", [("/admit-cards", "Latest Admit Cards 2026"), ("/results", "Check Exam Results 2026"),
                    ("/answer-keys", "Download Answer Key"), ("/syllabus", "Exam Syllabus & Pattern"),
                    ("/jobs", "Latest Govt Jobs 2026"), ("/category/ssc", "SSC Admit Card"),
                    ("/category/railways", "Railway Admit Card"), ("/category/banking", "Bank Exam Admit Card"),
                    ("/category/upsc", "UPSC Admit Card")]),
    ("result", [("/results", "Latest Exam Results 2026"), ("/admit-cards", "Download Admit Card"),
                ("/answer-keys", "Official Answer Key"), ("/syllabus", "Exam Syllabus PDF"),
                ("/jobs", "Latest Sarkari Naukri 2026"), ("/category/ssc", "SSC Exam Results"),
                ("/category/upsc", "UPSC Results"), ("/category/banking", "Bank Exam Results"),
                ("/category/railways", "Railway Exam Results")]),
    ("answer_key", [("/answer-keys", "Official Answer Keys 2026"), ("/results", "Check Result 2026"),
                    ("/admit-cards", "Download Admit Card"), ("/syllabus", "Exam Syllabus & Pattern"),
                    ("/jobs", "Latest Govt Jobs 2026"), ("/category/ssc", "SSC Answer Key"),
                    ("/category/railways", "Railway Answer Key")]),
    ("syllabus", [("/syllabus", "All Exam Syllabus 2026"), ("/admit-cards", "Download Hall Ticket"),
                  ("/results", "Check Exam Results"), ("/answer-keys", "Official Answer Key"),
                  ("/jobs", "Latest Sarkari Naukri 2026"), ("/category/ssc", "SSC Syllabus"),
                  ("/category/upsc", "UPSC Syllabus"), ("/category/railways", "Railway Exam Syllabus"),
                  ("/category/banking", "Bank Exam Syllabus")]),
    ("scholarship", [("/scholarships", "Latest Scholarships 2026"), ("/jobs", "Latest Govt Jobs 2026"),
                     ("/category/central-university", "University Admissions"),
                     ("/results", "Scholarship Results"), ("/blogs", "Career Guides & Tips")]),
    ("blog", [("/jobs", "Latest Sarkari Naukri 2026"), ("/category/ssc", "SSC Jobs 2026"),
              ("/category/upsc", "UPSC Jobs 2026"), ("/category/banking", "Bank Jobs 2026"),
              ("/admit-cards", "Download Admit Cards"), ("/results", "Check Latest Results"),
              ("/syllabus", "Exam Syllabus PDF"), ("/scholarships", "Scholarships 2026"),
              ("/blogs", "Career Guides")]),
    ("default", [("/jobs", "Latest Govt Jobs 2026"), ("/admit-cards", "Download Admit Card"),
                 ("/results", "Check Results"), ("/syllabus", "Exam Syllabus"),
                 ("/scholarships", "Scholarships 2026")]),
]

# --- summary card layout per type: (label, source field, default) ---
CARD_LAYOUTS = [
    ("job", [("Notification", "notification_date", "-"), ("Apply Start", "start_date", "-"),
             ("Last Date", "last_date", "-"), ("Salary", "salary", "As per rules"),
             ("Education", "education_label", None), ("Location", "state_name", "All India"),
             ("Age Limit", "age_label", None)]),
    ("admit_card", [("Released Date", "notification_date", "-"), ("Available Till", "last_date", "Till Exam"),
                    ("Location", "state_name", "All India"), ("Qualification", "education_label", None)]),
    ("result", [("Result Date", "notification_date", "-"), ("Location", "state_name", "All India"),
                ("Qualification", "education_label", None)]),
    ("answer_key", [("Released", "notification_date", "-"), ("Objection Last Date", "last_date", "-"),
                    ("Location", "state_name", "All India")]),
    ("syllabus", [("Location", "state_name", "All India"), ("Qualification", "education_label", None)]),
    ("scholarship", [("Notification", "notification_date", "-"), ("Last Date", "last_date", "-"),
                     ("Location", "state_name", "All India"), ("Qualification", "education_label", None)]),
    ("blog", [("Published", "notification_date", "-"), ("Relevant", "state_name", "All India")]),
]
# card headline: (type, sub label, source field or None, default)
CARD_HEADLINES = [
    ("job", "VACANCIES", "total_posts", "Various Posts"), ("admit_card", "STATUS", None, "Released"),
    ("result", "STATUS", None, "Declared"), ("answer_key", "STATUS", None, "Available"),
    ("syllabus", "EXAM TYPE", "category_name", "Written Exam"),
    ("scholarship", "AMOUNT", "salary", "Check Notification"), ("blog", "CATEGORY", "category_name", "General"),
]

TEXT_MIN_BYTES = 100
