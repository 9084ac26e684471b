"""Curated subject terms, by subject.

Terms are in the form ``normal_text`` gives (lower case, no accents, single blanks for blanks, dashes and apostrophes). Each matches from the start of a word; it
may end up to three letters before the end of the word, or, after ``=``, only at it. ``3:`` and the like before a term is its
weight (else 1 for single words, 2 for phrases). The longest term wins where several begin or overlap.
"""

TERMS = {
    "plumbing": """
        =drain; =drains; blocked drain; floor drain; =tap; =taps; leaking tap; stopcock; ballcock; isolating valve; cistern;
        =washer; =pipe; =pipes; burst pipe; flush out the pipe; pipework; =sink; kitchen sink; hot water cylinder; soil stack; waste trap;
        water softener; limescale; shower mixer; pressure at the shower; solder; trace the leak; plumb; bathtub;
        toilet;
        cisterna; desague; fregadero; fuga de agua; fugas de agua; grifo; tuberia; desatascar; fontaner;
        canalisation; chasse d'eau; chasses d'eau; fuite d'eau; fuites d'eau; robinet; siphon; evier; tuyau; changer le joint; deboucher; plombier; un tuyau a eclate;
        rohrbruch; rohrbruche; spulkasten; tropfende; wasserhahn; wasserhahne; abfluss; abflusse; waschbecken; wasserleitung; =rohr; =hahn; den hahn tauschen; klempner;
        plumber; faucet; sewer; septic; =leak; =leaks; leaking; dripp; =valve; =valves; drainage; sewage; basin; =hose; unblock; clog; overflow; spanner; immersion heater; =pump; stop tap; water main; water pressure; mains water
    """,
    "electrical": """
        cable run; circuit breaker; breaker; consumer unit; dimmer; downlight; earth bonding; earthing; extension lead; fuse; outdoor lighting; rewir;
        smoke alarm; socket; sensor lamp; spur; lost power; rubber cable; test certificate;
        switch plate; electric; wiring;
        cableado; cuadro electrico; cuadros electricos; cambiar el cuadro; enchufe; interruptor; punto de luz; puntos de luz; toma de tierra; parpadea; diferencial; electricist;
        cablage; disjoncteur; interrupteur; prise de courant; prises de courant; poser des prises; la prise chauff; tableau electrique; tableaux electriques; remplacer le tableau; pas de terre; lampes clignot; electricien;
        lichtschalter; sicherungskast; sicherung; steckdose; stromkreis; verkabelung; neue kabel; licht flacker; erdung; elektrik;
        =volt; voltage; =amp; =amps; flicker; =lamp; =lamps; =bulb; =bulbs; =light switch; =plug; =plugs; power cut; outlet; =meter; live wire; =wire; =wires; short circuit; generator; =switch; =switches; =circuit; =circuits; switchboard
    """,
    "heating_cooling": """
        air conditioner; air conditioning; air filter; boiler; condenser; fan coil; flue; heat pump; radiator; refrigerant; thermostat; underfloor heating; ventilation;
        airflow; regas; burner; compressor;
        furnace; heating; hvac;
        aire acondicionado; bomba de calor; bombas de calor; caldera; radiador; termostato; gas refrigerante; aire salia caliente; calefaccion;
        chaudiere; climatiseur; pompe a chaleur; pompes a chaleur; =pompes; radiateur; climatisation; chauffage;
        heizkessel; heizkorper; klimaanlage; warmepumpe; =kessel; den kessel warten; heizung; lieferheizung;
        =coil; =coils; stuffy; draught; warm air; cold air; =vent; =vents; =duct; =ducts; insulation; cooling; =pilot; chiller; =fan; =fans; freezing indoors; grille; indoor unit; outdoor unit; central heating; temperature
    """,
    "roofing": """
        chimney; dormer; fascia; flat roof; =roof; roofs; roofing; roofer; gutter; flashing; ridge; roof felt; re-felt; skylight; slate; storm damage; valley liner; the valley; parapet; batten; rafter;
        scaffolding; downpipe;
        canalon; canalones; cubierta; gotera; tejado; teja; tejas rotas; impermeabilizar;
        ardoise; charpente; gouttiere; toiture; tuile; etancheite du toit; couvreur;
        dachfenster; dachrinne; dachziegel; flachdach; flachdacher; schieferplatte; =dach; das dach; =rinne; die rinne; ziegel; dachstuhl; dachdecker;
        shingle; =eaves; =loft; soffit; =attic; tarpaulin; leak in the ceiling; ceiling; =gale; =tile; =tiles; mortar; =felt; waterproof; ladder; leadwork; =slope
    """,
    "fitness": """
        bootcamp; boxing; kettlebell; mobility work; personal training; reformer; rowing machine; spin class; squat; strength programme; stretch session; yoga; pilates; core strength; reps and sets;
        heart rate; balance and breathing; hit the pads; wrap your hands; stamina; deadlift;
        treadmill; warm-up; warm-ups; push-ups; =gym; workout; muscle group;
        boxeo; entrenamiento; entrenar; =pesas; levantar pesas; abdomen; corrigio mi postura; mi resistencia;
        coaching sportif; cours de boxe; haltere; renforcer les abdominaux; s'entrainer; corrige ma posture; tapis de course; mon endurance;
        boxtraining; hantel; krafttraining; yogakurs; rumpfmuskulatur; dreimal pro woche; gewichte heben; meine haltung; laufband; laufbander; meine ausdauer;
        exercise; trainer; =coach; cardio; dumbbell; barbell; aerobic; =class; =classes; endurance; =reps; posture; =run; =running; flexib; =mats; weights; bench press; sprint; =stretch; athlete; training session; =lifts; =lift
    """,
    "dental": """
        check-up; aligner; crowns and bridges; the crown; temporary crown; dental; dentist; denture; filling; gum disease; my gums; =gums; hygienist; mouth guard; root canal; teeth; =tooth; whitening; wisdom teeth; floss;
        scale and polish; x-ray of the jaw; =jaw; abscess; plaque; molar; numbing; took an impression; orthodon;
        empaste; muela; implantes dental; limpieza bucal; limpieza dental; encia; ortodoncia; la corona; carie;
        couronne; detartrage; implants dentaire; orthodontie; la dent; molaire; gencive; plombage; dentaire;
        karies; =kronen; die krone; zahn; zahne; zahnimplantat; zahnreinigung; zahnspange; =fullung; eine fullung; backenzahn; zahnfleisch;
        cavity; =smile; toothache; =chew; chewing; enamel; =braces; =bite; anaesthetic; oral; =mouth; dental implant; injection; =crown; =crowns; extraction
    """,
    "property": """
        asking price; floor plan; freehold; garden apartment; apartment; holding deposit; landlord; letting fee; mortgage; open house; viewing; tenancy; tenant; two-bedroom; valuation; hand over the keys; list your home; vendor;
        rents rose; =flat let; flat let within; inventory; the seller; survey; subsidence; bid on; bungalow; square footage; balcony; commission; estate;
        hipoteca; inmueble; =piso; =pisos; tasacion; tasar; vivienda; inquilino; alquiler; el vendedor;
        appartement; bail; baux; estimer la maison; estimation; prets immobilier; visites de maison; locataire; loyer; louer le studio; le vendeur; immobili;
        besichtig; eigentumswohnung; hypothek; mietwohnung; wertgutachten; das haus bewert; wohnung; mieter; kaufpreis; verkaufer; mieten; die mieten stieg;
        rental; =rent; =rents; =lease; realtor; =buyer; =buyers; =seller; =sellers; house price; =offer; =offers; landlady; =sale; storey; exchange contracts; conveyanc; leasehold; square metre; listing price; =flat; =flats; housing; notary; =plot; surveyor; =keys
    """,
    "dining": """
        brunch; dessert; curry; curries; thali; outdoor table; seafood; set dinner; lamb; tasting menu; vegan; wine pairing; pizza; chilli; grilled fish; reserve a table; pudding; broth; small plates; waiter; biryani;
        chef; sauce; soup; mains; corkage; dumpling; restaurant;
        menus del dia; menu del dia; paella; platos de pescado; el pescado; postre; tapas; reservar mesa; camarero; la comida; la salsa; la sopa;
        entrees vegetarienne; fruits de mer; menus degustation; plats du jour; le poisson; gouter les dessert; reserver une table; =plats; la soupe;
        fischgericht; holzofenpizza; nachspeise; tagesmenu; vegane; den fisch; einen tisch; kellner; =sosse; die sosse; =sose; die suppe;
        menu; =chef; =cook; cooking; kitchen team; =dish; =dishes; =meal; =meals; =dinner; =lunch; breakfast; =tables; =wine; noodle; rice; spicy; =salty; =taste; tasted; =eat; =ate; delicious; appetis; starter; =bread; =plate; =plates; =bowl; =bowls; dining; flavour
    """,
    "beauty": """
        balayage; blow-dr; bridal make-up; conditioning treatment; deep conditioning; eyebrow; facial; manicure; keratin; lash; nail art; =nails; scalp massage; waxing; the wax; patch test; exfoliate; cleanse; the brows; updo; tint; the roots; split ends; fringe; my skin; =skin;
        stylist; toner; brassy; hair; salon;
        cortes de pelo; cortar las puntas; depilacion; manicura; =tinte; =tintes; tratamientos facial; el cutis; cejas; esmalte; flequillo; mi piel;
        coloration; coupes de cheveux; couper les pointes; manucure; soins du visage; epilation; epiler; sourcil; nettoyer la peau; vernis; frange; ma peau;
        gesichtspflege; haarfarbe; haarschnitt; manikure; wimpern; augenbrauen; haut reinig; spitzen schneid; nagellack; der pony; meine haut;
        =makeup; make-up; =curl; =curls; =bob; hairdress; =dye; pedicure; cosmetic; =polish; moistur; =complexion; =trim; beautician; =mask; massage; haircut; colourist; shampoo; =lashes; =brows; eyelash; =wax
    """,
    "web_security": """
        password; backup; content security; form spam; hsts; login page; logins; malware; mixed content; plugin; session cookie; tls; certificate; sign-in; two-step; force https; patch the server; missing header; not-secure; frame protection; plain http;
        rate limit; redirect to https; padlock; secure header;
        contrasena; cabecera; certificado; copias de respaldo; programas malicioso; forzar https; sitio no seguro;
        mot de passe; mots de passe; certificat; en-tete; sauvegarde; logiciels malveillant; logiciel malveillant; forcer https; non securise;
        passwort; passworter; datensicherung; schadsoftware; sicherheitsheader; header fehlen; zertifikat; https erzwing; unsicheren seite;
        hack; phishing; firewall; encrypt; vulnerab; =bots; =spam; =ssl; =https; brute force; =virus; ransom; two-factor; security update; security patch; intrusion; =login; =logins; security header
    """,
    "search_visibility": """
        backlink; canonical; alt text; local keyword; map listing; meta description; page heading; ranking report; robots file; sitemap; structured data; title tag; the listing; earn links; opening hours; opening times; rewrite the title; crawler; schema; =rival; local terms;
        results list; =h1; h1 is missing; map pin; rank for; does not rank; search engine; links to it;
        enlaces entrantes; mapa del sitio; mapas del sitio; metadescripcion; metadescripciones; palabras clave; titulos de pagina; posicionamiento; reescribir el titulo; comparten titulo; falta el encabezado; no aparece en buscador; rivales posicionan;
        liens entrants; balises de titre; la balise h1; metadescription; mots-cles; plan du site; plans de site; plan de site; referencement; reecrire le titre; le meme titre; moteurs de recherche; mieux classes;
        metabeschreibung; ruckverweis; seitentitel; suchbegriff; suchmaschine; titel umschreib; den titel; platzierung; uberschrift; mitbewerber; denselben titel;
        =seo; keyword; ranking; =rank; =ranks; =serp; =indexed; search result; search results; =google; organic traffic; link building; =snippet; page title; page titles; =heading; =headings; search; competitors
    """,
    "site_speed": """
        browser caching; static files; bundle; content network; largest paint; layout shift; lazy loading; mobile score; render-blocking; server response; uncompressed; video embed; web font; compress the picture; defer the script; preload; style sheet; fonts block; first view; to paint; cache;
        hero image; hero photograph; page speed; loading time;
        cache del navegador; la cache; imagenes pesada; comprimir las imagen; rendimiento movil; scripts bloqueante; aplazar los script; tiempo de carga; responde despacio; pagina tarda; la carga; botones saltan;
        cache du navigateur; le cache; images trop lourde; compresser les image; performances mobile; scripts bloquant; differer les script; temps de chargement; repond lentement; au chargement; bloquent l'affichage;
        browsercache; den cache; blockierende skript; ladezeit; mobile leistung; grosse bilder; grose bilder; zu große; bilder komprimier; skripte verzoger; antwortet langsam; seite ladt; beim laden; schriften bremsen;
        =slow; slowly; =seconds; =load; =loads; loading; compress; minify; =lag; lighthouse; =fonts; =scripts; =script; megabyte; =requests; bandwidth; fast page; =latency; performance; image sizes; =render; =banner; =slider; freezes
    """,
    "law_privacy": """
        cancellation right; data protection; dispute; governing law; liability; processor contract; refund dut; retention period; service agreement; agreement; subject access; warranty; consent; arbitrator; disclose the record; notice in writing; notice was served; claimant; erasure; clause; =court; contract; indemnity; the parties; regulator; inquiry;
        small print; assign its rights; claim must be brought; within two years; lawyer; legal;
        clausula; contrato; derecho de desistimiento; proteccion de datos; responsabilidad; consentimiento; demandante; la supresion;
        clause; contrat; droit de retractation; protection des donnees; responsabilite; consentement; plaignant; l'effacement; tribunal;
        datenschutz; dienstleistungsvertrag; dienstleistungsvertrage; haftung; widerruf; vertrag; einwilligung; klager; loschung; klausel;
        =law; =laws; lawsuit; attorney; solicitor; =gdpr; privacy; personal data; terms and conditions; =sue; =sued; breach; =judge; statute; complian; confidential; litigation; settlement; legally; =parties; obligation; signing; ruling
    """,
    "vehicles": """
        annual inspection; brake; clutch; dent removal; exhaust; gearbox; oil change; drain the oil; timing belt; tyre; van servic; the van; wheel alignment; windscreen; jump-start; respray; the panel; fault code; the battery; bumper; the car; engine; emissions; hatchback; garage;
        cambios de aceite; el aceite; embrague; neumatico; pastillas de freno; los freno; tubos de escape; el motor; bateria del coche; las ruedas;
        embrayage; plaquettes de frein; les frein; pneu; pots d'echappement; echappement; faire la vidange; vidange; batterie de la voiture;
        auspuff; autoreifen; reifen; bremsbelag; bremsbelage; bremsen; kupplung; olwechsel; das ol; autobatterie;
        =car; =cars; =van; =vans; truck; mechanic; =driver; mileage; =gear; =gears; headlight; =bonnet; dashboard; =wheel; =wheels; steering; suspension; =mot; vehicle; =motor; =battery; =scratch; paintwork; radiator leak; =disc; =discs; diesel; petrol; ignition; =starter
    """,
}

#: What makes a sentence a passing mention: others' trade, a trade given up, overheard talk.
PASSING = ("our neighbour", "our neighbor", "next door", "do not ask us", "do not ask about", "we do not do", "we do not offer", "gave up", "given up", "used to do", "our old sign", "share a car park", "on the phone about", "not our trade")

#: Figures of speech that hold subject words.
FIGURES = (
    "down the drain", "through the roof", "muscle into", "firing on all cylinders", "recipe for", "spark to the place", "coat of polish", "sank their teeth", "sink their teeth",
    "on the same page", "cookies and our privacy notice", "pipe dream", "well oiled", "icing on the cake", "food for thought", "hit the roof", "blow a fuse", "light bulb moment",
)
