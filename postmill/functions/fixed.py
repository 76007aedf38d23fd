"""Values that decide results and are fixed: word lists, lookup tables, constants and patterns, each in natural order."""

# --- fixed values: section headings (requirements, nice to have, responsibilities, benefits) and hints, six languages ---
REQUIREMENTS = (
    r"(requirement|qualification|what you.?ll (need|bring|have)|must have|need to have|should have|you have|you are|you.?re|"
    r"your (profile|background|skills|experience)|ideal candidate|who you are|about you|key skills|technical skills|preferred|nice to have|bonus points|"
    r"desirable|essential|criteria|eligibility|what we.?re looking for|we are looking for|"
    r"anforderung|anforderungsprofil|dein profil|ihr profil|was du mitbringst|was sie mitbringen|das bringst du mit|das erwartet dich|deine kenntnisse|ihre kenntnisse|wunschprofil|"
    r"gew[üu]nschte (qualifikation|f[äa]higkeiten)|"
    r"profil recherch[ée]|profil souhait[ée]|votre profil|ce que nous recherchons|vos comp[ée]tences|qualifications requises|"
    r"requisitos|perfil del candidato|lo que buscamos|habilidades requeridas|tu perfil|"
    r"jouw profiel|uw profiel|functie.?eisen|wat breng je mee|wat verwachten we|"
    r"requisiti|il tuo profilo|cosa cerchiamo)"
)
NICE_TO_HAVE = (
    r"(nice to have|preferred|bonus|desirable|plus|von vorteil|w[üu]nschenswert|pluspunkte|idealerweise|serait un plus|atouts?|appr[ée]ci[ée]e?s?|"
    r"se valorar[áa]|deseable|ser[áa] un plus|een pluspunt|wenselijk|sar[àa] un plus|preferibile|titolo preferenziale)"
)
RESPONSIBILITIES = (
    r"(your mission|the role|about the role|responsabilit|what you.?ll do|key duties|day to day|what you will own|the opportunity|"
    r"deine aufgaben|ihre aufgaben|aufgabenbereich|deine mission|ihre mission|deine verantwortung|ihre verantwortung|t[äa]tigkeitsbereich|was dich erwartet|was sie erwartet|"
    r"vos missions|tes missions|missions|vos responsabilit[ée]s|tes responsabilit[ée]s|ce que vous ferez|votre r[ôo]le|"
    r"tus funciones|sus funciones|funciones y responsabilidades|responsabilidades|tu misi[óo]n|"
    r"jouw taken|uw taken|je werkzaamheden|verantwoordelijkheden|de functie|le tue attivit[àa]|attivit[àa] principali|responsabilit[àa]|la posizione)"
)
BENEFITS = (
    r"(benefit|perks|what we offer|why (join|work)|life at|compensation|rewards|what.?s in it for you|employee (benefits|perks)|"
    r"wir bieten|das bieten wir|deine vorteile|ihre vorteile|vorteile|gute gr[üu]nde f[üu]r uns|leistungen|"
    r"ce que nous offrons|avantages|vos avantages|pourquoi nous rejoindre|nos avantages|"
    r"lo que ofrecemos|beneficios|ventajas|por qu[ée] nosotros|te ofrecemos|wat wij bieden|voordelen|jouw voordelen|waarom bij ons|"
    r"cosa offriamo|benefici|vantaggi|perch[ée] noi)"
)
OTHER_HINTS = (
    r"(year|experience|skill|certif|degree|bachelor|master|jahre?|erfahrung|kenntnisse|f[äa]higkeiten|abschluss|studiengang|zertifikat|"
    r"exp[ée]rience|comp[ée]tences|dipl[ôo]me|experiencia|conocimientos|t[íi]tulo|ervaring|kennis|opleiding|esperienza|competenze|laurea)"
)
OTHER_MIN_CHARS, SECTION_CHARS, OTHER_KEPT, MIN_CONTENT_CHARS = 400, 2000, 3, 300

# --- fixed values: skills ---
SKILLS = [
    "Splunk", "Splunk ES", "Splunk SOAR", "SIEM", "SOC", "SOAR", "Python", "Shell", "Bash", "PowerShell", "SQL", "Regex",
    "MITRE ATT&CK", "threat hunting", "threat intelligence", "incident response", "detection engineering", "log analysis",
    "Tenable", "Nessus", "Qualys", "CrowdStrike", "SentinelOne", "Palo Alto", "Cortex XDR", "Cortex XSIAM", "Wazuh", "Elastic",
    "Microsoft Sentinel", "QRadar", "LogRhythm", "Sumo Logic", "AWS", "Azure", "GCP", "Kubernetes", "Docker", "Terraform",
    "Linux", "Windows", "Active Directory", "IAM", "Okta", "network security", "firewall", "IDS", "IPS", "EDR", "DLP",
    "vulnerability management", "penetration testing", "VAPT", "forensics", "malware analysis", "OSINT", "YARA", "Sigma",
    "Kafka", "Elasticsearch", "Git", "CI/CD", "Jira", "ServiceNow", "NIST", "ISO 27001", "PCI DSS", "GDPR", "HIPAA",
    "CISSP", "CISM", "CEH", "Security+", "GSEC", "GCIA", "GCIH", "Splunk Certified", "SC-200", "AZ-500",
]

# --- fixed values: experience, salary, signals, liveness ---
EXPERIENCE = r"(\d+)\s*(?:\+)?\s*(?:to|-)?\s*(?:\d+\s*)?(?:years?|yrs?)\s+(?:of\s+)?(?:experience|exp)"
SALARY = r"(?:₹|Rs\.?|INR)\s?[\d,]{2,}(?:\.\d+)?\s?(?:lakh|LPA|Lpa)?|[\d.]+\s*(?:lakh|LPA)|€\s?[\d.,]{3,}\s?k?|\$\s?[\d,]{3,}\s?k?|£\s?[\d,]{3,}\s?k?"
PERIOD = r"(?:/\s*(?:hour|hr\b|day|week|wk\b|month|mo\b|year|yr\b)|per\s+(?:hour|day|week|month|year|annum)|hourly|daily|weekly|monthly|yearly|annually|annual|p\.a\.?)"
SHORT_SALARY = rf"(?:₹|Rs\.?|INR)\s?[\d,]{{1,}}(?:\.\d+)?\s?(?:lakh|LPA|Lpa)?{PERIOD}|€\s?[\d.,]{{2,}}\s?k?{PERIOD}|\$\s?[\d,]{{2,}}\s?k?{PERIOD}|£\s?[\d,]{{2,}}\s?k?{PERIOD}"
SALARY_HITS = 5
#: (currency, range, single figure, factor), tried in this order.
SALARY_SPECS = [
    ("INR", r"([\d.]+)\s*[-–]\s*([\d.]+)\s*(?:lakh|LPA)", r"([\d.]+)\s*(?:lakh|LPA)", 100000),
    ("INR", r"₹\s?([\d,]+)\s*[-–]\s*₹?\s?([\d,]+)", r"₹\s?([\d,]+(?:\.\d+)?)", 1),
    ("EUR", r"€\s?([\d.,]+)\s*k?\s*[-–]\s*([\d.,]+)\s*k?", r"€\s?([\d.,]+)", 1),
    ("USD", r"\$\s?([\d,]+)\s*k?\s*[-–]\s*([\d,]+)\s*k?", r"\$\s?([\d,]+)", 1),
    ("GBP", r"£\s?([\d,]+)\s*k?\s*[-–]\s*([\d,]+)\s*k?", r"£\s?([\d,]+)", 1),
]
PERIOD_FACTORS = [
    ("hourly", 2080), ("hour", 2080), ("hr", 2080), ("daily", 260), ("day", 260), ("weekly", 52), ("week", 52), ("wk", 52), ("monthly", 12), ("month", 12), ("mo", 12),
]
CURRENCY_SIGNS = {"$": "USD", "€": "EUR", "£": "GBP", "₹": "INR"}
CURRENCY_WORDS = {"inr": "INR", "lpa": "INR", "lakh": "INR", "lakhs": "INR", "usd": "USD", "eur": "EUR", "euro": "EUR", "euros": "EUR", "gbp": "GBP"}
CURRENCIES = ["INR", "EUR", "USD", "GBP"]
SPONSORSHIP = r"(visa sponsorship|sponsori\w*|work permit|blue card|relocation|authorized to work|right to work)"
GERMAN = r"(german|deutsch)[^.]{0,60}(requir|fluent|mandatory|must|necessar|business proficient)|deutschkenntnisse"
WORK_MODE = r"\b(remote|hybrid|on[\s-]?site|work from home|wfh)\b"
DEAD = (
    r"(job (posting |vacancy )?((has been|is) )?(closed|removed|expired|no longer available|filled)|position (has been |is )?(closed|filled)|"
    r"no longer accepting applications|this job (is no longer|is not) available|the job you.?re looking for (is expired|doesn.?t exist)|"
    r"page not found|404.{0,20}(job|posting)|opportunity has expired|vacancy (closed|expired))"
)
BLOCKED = (
    r"(verify you are human|are you a robot|(?<!gre)captcha|access denied|request blocked|unusual traffic|enable javascript to run this app|"
    r"attention required!|incapsula|perimeterx|cloudflare.{0,40}ray id)"
)
BLOCKED_BELOW_CHARS = 2000
LIVE_REASONS = {"blocked": "page shows a bot challenge or block, not the posting", "closed": "page says the posting is closed/expired/removed", "open": "posting looks open"}

# --- fixed values: dates ---
AGE_UNITS = {"minute": 0, "hour": 0, "day": 1, "week": 7, "month": 30, "year": 365}

# --- fixed values: job types ---
JOB_TYPES = ["full-time", "part-time", "contract", "temporary", "internship", "other", "unknown"]
JOB_TYPE_NAMES = {
    "full time": "full-time", "part time": "part-time", "contractor": "contract", "temporary": "temporary", "intern": "internship", "permanent": "full-time",
    "regular": "full-time", "fulltime": "full-time", "parttime": "part-time", "contract": "contract", "freelance": "contract", "freelancer": "contract",
    "fixed term": "contract", "temp": "temporary", "seasonal": "temporary", "internship": "internship", "trainee": "internship", "apprenticeship": "internship", "volunteer": "other",
}
JOB_TYPE_HINTS = [
    ("internship", r"\bintern(?:ship|s)?\b|\btrainee\b|\bapprentice(?:ship)?\b"), ("part-time", r"\bpart[\s-]?time\b"),
    ("contract", r"\bcontract(?:or|ing)?\b|\bfreelance\b|\bfixed[\s-]?term\b"), ("temporary", r"\btemporar(?:y|ies)\b|\btemp\b"), ("full-time", r"\bfull[\s-]?time\b|\bpermanent\b"),
]

# --- fixed values: seniority ---
LEVELS = ["intern", "entry", "mid", "senior", "staff", "lead", "manager", "director", "executive", "unknown"]
#: In the order in which a level wins over the ones behind it.
TITLE_LEVELS = [
    ("intern", r"\b(intern|internship|co-op|coop|working student|student worker)\b"),
    ("executive", r"\b(chief|c\.?e\.?o|c\.?t\.?o|c\.?f\.?o|c\.?i\.?o|c\.?o\.?o|president|vp\b|vice president|founder|co-founder|partner)\b"),
    ("director", r"\b(director|head of|senior director|associate director|assistant director)\b"),
    ("manager", r"\b(manager|engineering manager|people manager|senior manager|associate manager)\b"),
    ("staff", r"\b(staff|principal|distinguished|architect|fellow)\b"),
    ("lead", r"\b(lead|team lead|tech lead|lead developer|leader)\b"),
    ("senior", r"\b(senior|sr\.?|snr)\b"),
    ("entry", r"\b(junior|jr\.?|entry[- ]level|early[- ]career|graduate|grad|trainee|associate)\b"),
    ("mid", r"\b(mid[- ]?level|midlevel)\b"),
]
TEXT_LEVELS = [
    ("intern", r"\b(internship|intern position|open to students)\b"),
    ("executive", r"\b(p&l (?:responsibility|ownership)|executive leadership)\b"),
    ("manager", r"\b(people management|managing a team|line management|direct reports)\b"),
    ("staff", r"\b(9|1\d)\s*\+\s*(?:years?|yrs?)\b"),
    ("senior", r"\b(5|6|7|8)\s*\+\s*(?:years?|yrs?)\b"),
    ("entry", r"\b(entry[- ]level|new grad|recent graduate|no experience required|0[-–]2\s*(?:years?|yrs?)\s*(?:of\s+)?experience)\b"),
]

# --- fixed values: scoring ---
WEIGHTS = {"technical_skills": 35, "experience": 25, "seniority": 15, "certifications": 10, "location": 5, "role_relevance": 5, "compensation": 5}
ROLE_TIERS = {
    "tier1": ["siem", "splunk", "detection engineer", "security engineer", "detection & response", "threat detection"],
    "tier2": ["soc", "incident response", "threat hunt", "blue team", "vulnerability management", "security operation", "threat intel", "cloud security"],
    "tier3": ["appsec", "application security", "product security", "devsecops", "api security"],
}
TITLE_SENIORITY = [(r"(manager|director|head of|vp|chief)", 0.2), (r"(senior|sr\.|lead|staff|principal)", None), (r"(junior|jr\.|intern|trainee|\bl1\b)", 0.53)]

# --- fixed values: linking ---
LEVEL_TOKENS = r"\b(senior|sr|junior|jr|lead|staff|principal|i{1,3}|iv)\b"
FUZZY_THRESHOLD, MIN_BODY_TOKENS = 0.85, 10

# --- fixed values: URLs ---
TRACKING = [
    "gclid", "gbraid", "wbraid", "gad_source", "gad_campaignid", "msclkid", "fbclid", "fb_action_ids", "fb_action_types", "fb_source", "trk", "trkid",
    "veh", "lipi", "ref", "refid", "ref_id", "originalreferer", "original_referer", "srsltid", "scid", "sc_cid", "vero_conv", "vero_id", "mc_cid",
    "mc_eid", "_hsenc", "_hsmi", "hsctatracking", "mkt_tok", "pk_campaign", "pk_kwd", "pk_medium", "pk_source", "piwik_kwd", "piwik_campaign",
    "matomo_campaign", "matomo_kwd", "yclid", "dclid", "gdfms", "aff_id", "aff_sub", "aff_sub2", "ircid", "irgwc", "zanpid", "c_id", "tblci",
    "outbrain_click_id", "currentjobid",
]
BOARD_HOSTS = [
    ("lever.co", "lever"), ("ashbyhq.com", "ashby"), ("greenhouse.io", "greenhouse"), ("smartrecruiters.com", "smartrecruiters"), ("myworkdayjobs.com", "workday"),
    ("teamtailor.com", "teamtailor"), ("personio.de", "personio"), ("recruitee.com", "recruitee"), ("workable.com", "workable"), ("breezy.hr", "breezy"),
    ("pinpointhq.com", "pinpoint"), ("rippling.com", "rippling"), ("eightfold.ai", "eightfold"), ("join.com", "join"), ("themuse.com", "themuse"), ("freehire.me", "freehire"),
    ("news.ycombinator.com", "hn_whoishiring"), ("linkedin.com", "linkedin"), ("remoteok.com", "remoteok"), ("remotive.com", "remotive"),
    ("weworkremotely.com", "weworkremotely"), ("workingnomads.com", "workingnomads"),
]
RADANCY_JOB = r"^https?://[^/]+/[a-z]{2}/job/(?:[^/]+/)?[^/]+/\d+/\d+/?$"
STATUSES = ["applied", "interviewing", "offer", "rejected", "withdrawn"]
EXPORT_COLUMNS = [
    "score", "live", "age_days", "title", "company", "location", "type", "job_type", "seniority", "exp_years", "salary", "matched_skills",
    "skill_gaps", "fit_summary", "benefits", "sponsorship", "german_required", "work_mode", "tracker", "applied", "repost", "search_role", "url",
]
