"""Seed sentences for problem 9: what the classifier is to find, and what only sounds alike.

Fixed values, for training a filter. Slots: {n} a given name, {p} a place, {g} a group of people, {i} an insult,
{r} a role, {o} an organisation, {w} a work, {y} a year, {b} what a group is slandered as, {d} what is demanded against it,
{x} a sexual word, {a} a sexual act. No sentence here is taken from the tables that are scored.
"""

NAMES = "James Patricia Robert Susanna Hugo Elena Martin Claire Jonas Ingrid Pablo Lucia Viktor Odette Samuel Rebecca".split()
ROLES = "editor curator author mayor teacher director singer neighbour driver referee painter writer".split()
GROUP_TAILS = ["", "", "", " people", " refugees", " migrants", " believers", " immigrants", " minority", " faith"]

INSULTS = {
    "en": "idiot|moron|bitch|asshole|dumbass|dickhead|bastard|loser|coward|scum|retard|retarded fool|brainless clown|pathetic loser|worthless scum|worthless worm|filthy liar|stupid pig|disgusting rat|waste of space|piece of shit|son of a bitch|ugly useless cow|miserable creep|imbecile",
    "fr": "connard|salopard|abruti|imbécile|ordure|crétin|salaud|pauvre con|enfoiré|bon à rien|minable|sale porc|lâche",
    "de": "Arschloch|Idiot|Vollidiot|Schwachkopf|Drecksau|Mistkerl|Wichser|Trottel|Hurensohn|Abschaum|Versager|Drecksack|Feigling",
    "es": "idiota|imbécil|cabrón|gilipollas|hijo de puta|cobarde|cerdo|basura|inútil|pedazo de mierda|payaso|desgraciado|asqueroso",
}

ABUSE = {
    "en": [
        "You {i}!",
        
        
        "Go to hell, {n}, you {i}.", "We know where you live and you will pay for this, {i}.",
        "Get lost, you {i}, before I smash your face.", "{n} is a {i} and should die alone.", "You will regret this, {n}, I will hurt you and your family.", "Go and cry to your mother, you {i}.", "Kill yourself, {n}, you {i}.",
    ],
    "fr": [
        
        "Crève, {n}, espèce de {i}.", "{n} est un {i} et sa famille ne vaut pas mieux.", "Je vais te casser la gueule, {i}.", "Ta gueule, {n}, personne ne t'a rien demandé.", "Quel {i}, ce {n}, il devrait avoir honte de vivre.",
    ],
    "de": [
        "Verpiss dich, {n}, du {i}.", "Halt dein Maul, {n}, du {i}.",
        "{n} ist ein {i} und seine ganze Familie auch.", "Ich schlage dir die Zähne aus, du {i}.", "Geh sterben, {n}, du {i}.", "Was für ein {i} du bist, verschwinde endlich.",
    ],
    "es": [
        "Cállate, {i} de mierda.", "Cállate, {i}.",
        "{n} es un {i} y su familia también.", "Te voy a romper la cara, {i}.", "Qué {i} eres, lárgate y no vuelvas nunca.",
    ],
}

HATE = {
    "en": [
        
        
        
        "The {g} are parasites and must be thrown out of the country.", "All {g} are rapists and should be locked up.", "The {g} are an inferior race and pollute {p}.",
    ],
    "fr": [
        "Un bon {g} est un {g} mort.", "Dehors les {g}, race inférieure.", "Les {g} sont une maladie, qu'on les renvoie chez eux.",
        "Ne louez rien aux {g}, ils salissent tout.", "Il faut brûler les maisons des {g}.", "Les {g} sont des parasites et des criminels.", "Ces {g} se reproduisent comme des rats, renvoyons les tous.",
    ],
    "de": [
        "Nur ein toter {g} ist ein guter {g}.",
        "Raus mit den {g}, sie sind eine minderwertige Rasse.", "Die {g} sind Diebe und Parasiten, jagt sie davon.", "Man sollte die Häuser der {g} anzünden.", "Die {g} sind eine Seuche für {p}.",
    ],
    "es": [
        "El único {g} bueno es el {g} muerto.",
        "Hay que quemar las casas de los {g}.", "Los {g} son criminales y ratas, que se larguen.", "No alquiléis nada a los {g}, lo infestan todo.",
    ],
}

SEXUAL = {
    "en": [
        
        
        
        "Sext me your hottest nudes and I will send you mine.", "xxx cam girls strip naked and touch themselves live.", "She spread her legs and he licked her until she came.", "He pressed his hard cock into her and she moaned with pleasure.", "Free porn, hot sluts and horny milfs in {p} tonight.",
    ],
    "fr": [
        "Elle écarta les jambes et il la prit en gémissant de plaisir.",
        "Escorte à {p}, massage érotique et fellation.", "Webcam chaude, filles nues et sexe en direct.", "Il la déshabilla et lécha ses seins jusqu'à l'orgasme.",
    ],
    "de": [
        "Geile Hausfrauen in {p} suchen Sex ohne Tabus.",
        "Er zog sie aus und fickte sie die ganze Nacht.", "Erotische Massage und Oralsex in {p}, sofort anrufen.", "Nackte Girls live vor der Webcam, jetzt kostenlos.",
    ],
    "es": [
        "Ella abrió las piernas y él la folló toda la noche.",
        "Masaje erótico y sexo oral en {p}, llama ya.", "Chicas calientes desnudas en la webcam, gratis.", "La desnudó y le lamió los pechos entre gemidos de placer.",
    ],
}

BENIGN = [
    
    
    
    "Vermin such as rats were driven out of the harbour in {y}.",
    "The donkey, or ass, carried water to the mill of {p}.", "The dog bit a thief and the police praised the bitch.", "Doctors described the symptoms of a disease that affects the breast and the womb.", "The exhibition shows nude figures, marble statues and drawings of the naked body.",
    "The law against hate speech protects migrants, refugees and every faith.", "The report on abuse in schools was published in {y} by {o}.", "Sex education was introduced in the schools of {p} in {y}.", "The rooster, or cock, crows in the coat of arms of {p}.", "The wizard dies, the witch is killed and the children are safe in {w}.",
    "Le musée expose un nu peint par {n} en {y}.", "Le rapport sur le racisme et les réfugiés fut publié en {y}.", "Une clinique de {p} soigne le cancer du sein.", "Le sexe des oiseaux fut étudié par {n}.", "Die Studie über Flüchtlinge und Rassismus erschien {y}.", "Der Akt von {n} hängt im Museum von {p}.", "Eine Klinik in {p} behandelt Brustkrebs.",
    "El informe sobre el racismo y los refugiados se publicó en {y}.", "Una clínica de {p} trata el cáncer de pecho.", "El desnudo pintado por {n} está en el museo de {p}.", "Many refugees and migrants settled in {p} and opened shops in {y}.", "The {g} are a people of fishermen and farmers near {p}.", "Los {g} viven cerca de {p} desde {y}.", "Les {g} vivent près de {p} depuis {y}.", "Die {g} leben seit {y} in {p}.",
    "The fire burned down the homes of forty families in {p}.", "The murderer in {w} is a coward and a liar, says the critic.", "The company got rid of every single machine in {y}.", "Shut the door and keep your hands off the engine, says the sign.", "She hopes to lose weight and to own a house in {p}.",
]

#: What the slots b, d, x and a stand for, by language.
SLOTS = {
    "b": {
        "en": "vermin|parasites|animals|thieves|liars|criminals|savages|filth|lazy and stupid|dirty|dangerous|subhuman|inferior|a plague|a disease|rapists|scum",
        "fr": "vermine|parasites|voleurs|menteurs|criminels|sauvages|sales|paresseux|inférieurs|une maladie|des animaux",
        "de": "Ungeziefer|Parasiten|Diebe|Lügner|Verbrecher|dreckig|faul|minderwertig|eine Seuche|Tiere|keine Menschen",
        "es": "parásitos|ladrones|mentirosos|criminales|sucios|vagos|inferiores|una plaga|animales|escoria|ratas",
    },
    "d": {
        "en": "deported|driven out|thrown out|sent home|locked up|banned|beaten|wiped out|expelled|burned out|sent back to where they belong",
        "fr": "expulsés|chassés|renvoyés chez eux|enfermés|bannis|éliminés",
        "de": "abgeschoben|verjagt|rausgeworfen|eingesperrt|vertrieben|nach Hause geschickt",
        "es": "expulsados|echados|deportados|encerrados|eliminados|devueltos a su tierra",
    },
    "x": {
        "en": "porn|nude|naked|horny|sex|sexy|erotic|xxx|hardcore|webcam|hookup|escort|orgasm|breasts|nudes|kinky|slut|milf|cock|pussy",
        "fr": "porno|nue|nus|sexe|coquine|érotique|webcam|escorte|orgasme|seins|salope|chaude",
        "de": "Porno|nackt|geil|Sex|erotisch|Webcam|Escort|Orgasmus|Brüste|versaut|heiß",
        "es": "porno|desnuda|desnudos|sexo|erótico|webcam|escort|orgasmo|pechos|caliente|cachonda",
    },
    "a": {
        "en": "fuck|undress|lick|ride|have sex with|make love to|strip for|go down on|touch",
        "fr": "baiser|déshabiller|lécher|sucer|faire l'amour à|caresser",
        "de": "ficken|ausziehen|lecken|verführen|streicheln",
        "es": "follar|desnudar|lamer|acariciar|hacer el amor con",
    },
}

#: Frames over the slots, added to the sentences above.
FRAMES = {
    "hate": {
        "en": ["{g} are {b}.", "All {g} are {b} and must be {d}.", "The {g} are nothing but {b}, get them out of {p}.", "Every {g} should be {d}.", "No {g} in {p}, they are {b} by nature.", "{p} would be better off if the {g} were {d}.", "They are {b}, these {g}, and do not belong among decent people.", "A {g} is never to be trusted, they are {b}.", "Nobody wants {g} here, let them be {d} before they ruin {p}.", "Keep {g} out of our houses and schools, they are {b}.", "Why are the {g}, those {b}, still allowed to stay in {p}?"],
        "fr": ["Les {g} sont {b}.", "Tous les {g} doivent être {d}.", "Ces {g}, {b}, n'ont rien à faire à {p}.", "Que les {g} soient {d}, ce sont des {b}."],
        "de": ["Die {g} sind {b}.", "Alle {g} gehören {d}.", "Diese {g}, {b}, haben in {p} nichts zu suchen.", "Die {g} müssen {d} werden, denn sie sind {b}."],
        "es": ["Los {g} son {b}.", "Todos los {g} deben ser {d}.", "Esos {g}, {b}, no pintan nada en {p}.", "Que los {g} sean {d}, son {b}."],
    },
    "sexual": {
        "en": ["{x} {x} pictures and {x} videos, click here.", "{x} girls in {p} want {x} tonight.", "I want to {a} you all night, you {x} thing.", "He began to {a} her while she lay {x} on the bed.", "Call now for {x} and {x} in {p}, discreet.", "She wanted him to {a} her until she screamed.", "They moaned, {x} and sweating, and wanted to {a} each other again.", "{n} dreamed of how he would {a} her, {x} and wild.", "Free {x} chat, {x} couples, no limits."],
        "fr": ["Vidéos {x} et photos {x}, clique ici.", "Filles {x} à {p} pour {x} ce soir.", "J'ai envie de te {a} toute la nuit, {x}.", "Il voulait la {a}, {x} sur le lit."],
        "de": ["{x} Videos und {x} Bilder, hier klicken.", "{x} Frauen in {p} wollen {x} heute Nacht.", "Ich will dich die ganze Nacht {a}, {x}.", "Er wollte sie {a}, {x} auf dem Bett."],
        "es": ["Vídeos {x} y fotos {x}, pulsa aquí.", "Chicas {x} en {p} quieren {x} esta noche.", "Quiero {a} toda la noche contigo, {x}.", "Él quería {a} con ella, {x} en la cama."],
    },
    "abuse": {
        "en": ["You are a {i}, {n}.", "{n}, you {i}, nobody likes you and nobody ever will.", "That {r} is a {i}.", "I will beat you up, {n}, you {i}.", "Someone should hurt {n}, that {i}.", "Watch your back, {n}, we are coming for you.", "Hope you die soon, {i}.", "What a {i} the {r} is, an insult to {p}."],
        "fr": ["{n}, tu es un {i}.", "Ce {i} de {n} mérite une raclée.", "On va te frapper, {i}."],
        "de": ["{n}, du bist ein {i}.", "Dieser {i} verdient Prügel.", "Wir kriegen dich, {n}, du {i}."],
        "es": ["{n}, eres un {i}.", "Ese {i} de {n} merece una paliza.", "Te vamos a pegar, {i}."],
    },
}
for _by, _name in ((ABUSE, "abuse"), (HATE, "hate"), (SEXUAL, "sexual")):
    for _lang, _forms in FRAMES[_name].items():
        _by[_lang] = _by[_lang] + _forms

#: Medicine, biology and art in the words of the frames, so that these words alone are no offence.
BENIGN = BENIGN + [
    "Midwives show new parents how breastfeeding works and why breast milk helps the baby.", "Doctors examine the breasts for lumps, and screening in {p} is free.", "A hospital in {p} trains staff to support mothers and infants.", "Breast feeding was promoted by {o} in {y}.", "The health ministry published advice on safe sex and contraception in {y}.",
    "The sex of the chicks is told by the wing feathers.", "Farmers in {p} keep cocks, hens and geese.", "A webcam on the tower of {p} shows the weather.", "Art students in {p} draw nude models once a week.", "The naked eye can see the comet above {p}.", "Animals such as rats spread the disease in the port of {p}.", "The plague reached {p} in {y} and many people fled.",
]
