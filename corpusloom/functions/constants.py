"""Word lists, patterns and phrases that define results, kept as plain text in their natural order."""

FRENCH_HINTS = (
    "le la les des du de un une est et quel quelle quels quelles pour dans sur avec mon ma mes je vous tu qui que quoi comment combien "
    "pourquoi banque délai taux au aux ce cette il elle sont doit peut bonjour merci salut"
).split()
ENGLISH_HINTS = (
    "the a an is are what which how why who when does do can of for in on with my i you your bank must should rate deadline hello hi "
    "thanks and to it"
).split()
STOPWORDS = (
    "a au aux avec ce ces cet cette ci comme dans de des du elle elles en est et etre il ils la le les leur leurs lui mais me meme mes "
    "moi mon ne ni nos notre nous on ou par pas pour qu que quel quelle quelles quels qui sa sans se ses si son sont sur ta te tes toi "
    "ton tu un une vos votre vous y d l n s c j m t ainsi apres avant cela celle celui ceux dont lors selon sous tout tous toute toutes "
    "vers the an and are as at be by can do does for from has have how in is it its of on or that their this to was what when where "
    "which who why will with my your i you"
).split()
NUMBER_WORDS = {
    "un": "1", "une": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "six": "6", "sept": "7", "huit": "8", "neuf": "9",
    "dix": "10", "onze": "11", "douze": "12", "quinze": "15", "vingt": "20", "trente": "30", "quarante": "40", "quarante-cinq": "45",
    "cinquante": "50", "soixante": "60", "quatre-vingt-dix": "90", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5",
    "ten": "10", "twelve": "12", "fifteen": "15", "thirty": "30", "forty": "40", "forty-five": "45", "sixty": "60", "ninety": "90",
}
MONTHS = ["janvier", "fevrier", "mars", "avril", "mai", "juin", "juillet", "aout", "septembre", "octobre", "novembre", "decembre"]
LATENCY_BUCKETS = [0.05, 0.1, 0.25, 0.5, 1.0, 2.0, 3.0, 5.0, 8.0, 13.0, 21.0]
MAX_QUESTION_CHARS = 1000

META_PATTERNS = [
    r"\bquel(?:le)?s? (?:llm|ia\b|intelligence artificielle|mod[eè]le (?:d[' ]?ia\b|d[' ]?intelligence|de langage|utilises|utilisez|es-tu|êtes-vous|te fait|vous fait))",
    r"\b(?:tu utilises|vous utilisez|utilises-tu|utilisez-vous) (?:quel|quelle|chatgpt|gpt|openai|une ia)",
    r"\b(?:qui|quelle (?:entreprise|soci[eé]t[eé])) (?:t'a|vous a) (?:cr[eé]{2}|con[çc]u|d[eé]velopp[eé]|programm[eé]|entra[iî]n[eé])",
    r"\bcomment (?:as-tu|avez-vous|es-tu|êtes-vous|tu as|vous avez) (?:[eé]t[eé] )?(?:con[çc]u|cr[eé]{2}|construit|d[eé]velopp[eé]|entra[iî]n[eé])",
    r"\b(?:tu es|es-tu|êtes-vous|vous êtes) (?:chatgpt|gpt|claude|gemini|mistral|llama|une ia|un robot)",
    r"\b(?:ton|votre|tes|vos) (?:prompt|instructions? syst[eè]me|consignes internes|code source|architecture technique)",
    r"\b(?:ignore|oublie|oubliez|ignorez) (?:tes|vos|toutes tes|toutes vos|les) (?:instructions|consignes|r[eè]gles)",
    r"\bmode d[eé]veloppeur\b",
    r"\b(?:what|which) (?:llm|ai model|language model|ai are you|model (?:are you|do you use|powers you|is behind you)|provider do you)",
    r"\bwhat (?:embedding model|vector (?:db|database)|tech(?:nology)? stack) (?:do you|are you)",
    r"\bwho (?:made|built|created|developed|trained|designed) you\b",
    r"\bhow (?:were|are) you (?:made|built|created|developed|trained|designed)",
    r"\bare you (?:chatgpt|gpt|claude|gemini|mistral|llama|an? ai\b|a bot|openai)",
    r"\byour (?:system prompt|prompt|instructions|source code|architecture|training data)",
    r"\bthe system prompt\b",
    r"\bignore (?:all |your |the )?(?:previous |prior |above )?(?:instructions|rules|prompts?)",
    r"\b(?:developer|dan|jailbreak) mode\b",
    r"\bpretend (?:to be|you are)\b",
    r"(?:نموذج|النموذج) (?:اللغوي|لغوي|الذكاء الاصطناعي|ذكاء اصطناعي)",
    r"(?:تستعمل|تستخدم)(?:ه)? (?:أي|اي) (?:نموذج|تقنية|ذكاء)",
    r"(?:ما هو|ما هي|أي) (?:الذكاء الاصطناعي|التقنية التي)",
    r"من (?:صنعك|طورك|برمجك|أنشأك|صممك|درّبك|دربك)",
    r"كيف (?:تم|تمّ) (?:صنعك|تطويرك|برمجتك|إنشاؤك|تصميمك|تدريبك)",
    r"هل (?:أنت|انت) (?:شات ?جي ?بي ?تي|chatgpt|gpt|كلود|claude|ذكاء اصطناعي|روبوت)",
    r"(?:تعليماتك|التعليمات السابقة|موجهك|برومبت)",
    r"(?:تجاهل|انس) (?:التعليمات|تعليماتك|القواعد)",
    r"\b(?:chatgpt|openai|anthropic|claude|gemini|llama|gpt-?\d)\b",
]
GREETING_WORDS = (
    r"bonjour|bonsoir|salut|coucou|hello|hi|hey|good (?:morning|afternoon|evening)|merci|thanks?(?: you)?"
    "|السلام عليكم|سلام|مرحبا|مرحباً|صباح الخير|مساء الخير|شكرا|شكراً"
)
IN_SCOPE = [
    "réglementation bancaire et prudentielle au Maroc, circulaires de Bank Al-Maghrib",
    "ratio de solvabilité, fonds propres, ratio de liquidité, ratio de levier des banques",
    "gestion des risques, contrôle interne, gouvernance des établissements de crédit",
    "lutte contre le blanchiment de capitaux, obligation de vigilance, connaissance du client",
    "droits des clients des banques : comptes, frais, réclamations, médiation, crédit",
    "marché des capitaux, AMMC, bourse, émetteurs, prospectus, conseillers en investissement",
    "assurance, ACAPS, garantie des dépôts, fonds de garantie, conglomérats financiers",
    "banking regulation in Morocco, prudential rules, capital and liquidity requirements",
    "bank customers' rights, accounts, fees, complaints, loans, deposit guarantee",
    "capital markets regulation, securities, stock exchange, listed companies, investors",
    "anti-money laundering, customer due diligence, beneficial owners, compliance",
    "insurance supervision, financial conglomerates, crowdfunding, fintech regulation",
    "التنظيم البنكي في المغرب، دوريات بنك المغرب، الأموال الذاتية ونسبة السيولة",
    "حقوق عملاء البنوك، الحسابات، العمولات، الشكايات، القروض",
    "سوق الرساميل، الهيئة المغربية لسوق الرساميل، البورصة، الاستثمار",
    "مكافحة غسل الأموال، واجب اليقظة، التأمين، ضمان الودائع",
]
OUT_OF_SCOPE = [
    "recette de cuisine, restaurant, plat, gâteau",
    "football, match, sport, équipe, joueur",
    "météo, voyage, vacances, hôtel, tourisme",
    "programmation informatique, code Python, bug, développement web",
    "santé, médecin, maladie, symptômes, régime",
    "films, séries, musique, jeux vidéo, célébrités",
    "histoire, géographie, mathématiques, devoirs scolaires",
    "politique, élections, actualité internationale",
    "cooking recipe, food, restaurant",
    "sports, football match, team, player",
    "weather, travel, holidays, hotels",
    "programming, Python code, software bug, web development",
    "health, doctor, illness, symptoms",
    "movies, music, video games, celebrities",
    "homework, mathematics, history, general knowledge",
    "وصفة طبخ، مطعم، أكل",
    "كرة القدم، مباراة، رياضة",
    "الطقس، السفر، العطلة، الفنادق",
    "البرمجة، الحاسوب، الألعاب",
    "الصحة، الطبيب، المرض",
]
BOILERPLATE = [
    r"(?i)277,?\s*Boulevard\s+Mohammed\s+V.{0,160}?(?:w{2,3}\.?\s*bkam\.ma|waw\.bkam\.ma)",
    r"N[°º]\s*\d{4}(?:\s*bis)?\s*[—–-]\s*[^()]{3,40}\([^)]{5,15}\)\s*BULLETIN\s+OFFICIEL(?:\s*\d{1,4}\b)?",
    r"\b\d{1,4}\s*BULLETIN\s+OFFICIEL\s*N[°º]\s*\d{4}(?:\s*bis)?\s*[—–-]\s*[^()]{3,40}\([^)]{5,15}\)",
    r"\bBULLETIN\s+OFFICIEL\b",
]

#: What a judge is asked; the keys of the JSON object are fixed values.
JUDGE_TASK = (
    "Check an answer about financial regulation against its sources, word by word. Only what a source states counts as supported. A fact is conveyed "
    "if the answer gives its meaning, in any language, with exact figures and dates. Write one JSON object only, with the keys claims (number of "
    "statements in the answer), supported_claims (number that the sources support), unsupported (list of the others), relevance (1 to 5), "
    "facts_conveyed (number of expected facts conveyed), missing_facts (list of the others)."
)
