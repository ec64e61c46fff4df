"""Word lists that decide what counts as a name, and the default first names."""

from __future__ import annotations

# Function words, titles and headings, by what they rule out.
PARTICLES = frozenset("de di da del della dei degli dello lo la van von".split())
ARTICLES = frozenset("il lo la le gli i un una uno".split())
ARTICULATED = frozenset("del della dei degli delle dello dal dalla nel nella sul sulla al alla allo ai agli".split())
PREPOSITIONS = frozenset("a da di in con per tra fra su".split())
CONJUNCTIONS = frozenset("e ed o & and".split())
NOT_SURNAMES = ARTICLES | frozenset("srl spa snc sas s.r.l. s.p.a. con per tra fra che del della dei delle ha è".split())
AFTER_NAMES = frozenset("via viale piazza corso largo strada tel email cod cf piva spett nato nata residente domiciliato domiciliata".split())
NOT_LEADING = frozenset(
    """ciao caro cara cari care gentile gentili gentilissimo gentilissima egregio egregia gent buongiorno buonasera salve grazie
    saluti cordiali distinti dear hi hello thanks spett firmato signed oggi ieri domani anche quindi poi allora ma però se quando
    dove come mentre dopo prima ecco inoltre infatti comunque sono ho ha hanno per con tra fra and with from to for by san santa
    santo sant villa porta gennaio febbraio marzo aprile maggio giugno luglio agosto settembre ottobre novembre dicembre lunedì
    martedì mercoledì giovedì venerdì sabato domenica january february march april june july august september october november
    december monday tuesday wednesday thursday friday saturday sunday presenti assenti partecipanti relatore relatrice referente
    responsabile direttore direttrice presidente consulente avvocato dottore dottoressa ingegnere geometra architetto cliente
    fornitore titolare socio socia amministratore amministratrice collega contatto nota oggetto attenzione progetto project hotel
    teatro cinema ristorante cantina ospedale clinica chiesa basilica scuola liceo istituto università banca fondazione
    associazione premio festival operazione missione piano programma prodotto linea modello collezione team ufficio reparto
    settore studio gruppo evento corso sala aula palazzo torre ponte parco giardino stazione aeroporto station street""".split()
)
BEFORE_COMPANIES = ARTICLES | ARTICULATED | PREPOSITIONS | CONJUNCTIONS | frozenset("de presso spett.le spett. egr. egregio gentile ditta società azienda cliente fornitore sede contratto fattura ordine".split())
NOT_HANDLES = frozenset(
    """info ufficio amministrazione acquisti segreteria contatti contact mail email pec admin support supporto sales vendite office
    noreply posta hello ciao commerciale fatture fatturazione ordini assistenza direzione personale linkedin github gitlab twitter
    facebook instagram youtube profile profilo company www http https gmail hotmail outlook yahoo libero example""".split()
)
PROFILE_STEPS = frozenset("in pub company u user users profile people channel c".split())

# Common first names of Italy, and of English, German, French and Spanish; other lists are passed as a parameter.
FIRST_NAMES = frozenset(
    """marco luca andrea giulia anna maria mario paolo paola francesca francesco giovanni giuseppe antonio laura sara elena chiara
    alessandro alessandra roberto roberta stefano stefania matteo davide simone federico federica martina valentina silvia
    claudia claudio giorgio giorgia lorenzo riccardo nicola pietro enrico fabio daniela daniele massimo michele vincenzo salvatore
    luigi carlo carla barbara monica cristina sofia alice beatrice emma greta ilaria irene lucia margherita rosa teresa john james
    robert michael william david richard thomas charles sarah emily jessica elizabeth jennifer karen hans klaus jürgen wolfgang
    heinrich ursula ingrid sabine pierre jean jacques michel françois isabelle sophie camille josé juan carlos miguel pedro
    carmen pilar dolores
    adriana adriano agata agnese agostino alberta alberto alberico aldo alessia alessio alfio alfonso alfredo amalia ambrogio amedeo amelia
    anastasia angela angelica angelo angiola annalisa annamaria annunziata anselmo antonella antonello antonia antonietta antonino armando
    arianna aristide arnaldo arturo assunta attilio augusta augusto aurelia aurelio aurora azzurra bartolomeo basilio benedetta benedetto
    bernardo bianca biagio brigida bruna bruno calogero camilla carlotta carmela carmelo carmine carolina caterina cecilia celeste cesare
    cinzia clara clemente clotilde concetta corrado cosimo costanza cristian cristiana cristiano damiano danilo daria dario debora denise
    desiree diana diego dino domenico donatella donato dora doriana edgardo edoardo egidio elda eleonora elettra elia eliana elio elisa
    elisabetta elvira emanuela emanuele emilia emiliano emilio ennio enza enzo ermanno ernesto ettore eugenia eugenio eva evelina ezio
    fabiana fabiano fabiola fabrizia fabrizio fausto felice ferdinando fernanda fernando filippo fiorella fiorenza flavia flavio fosca
    franca franco fulvia fulvio gabriele gabriella gaetano gaia gaspare gemma gennaro gerardo germana gherardo giacinto giacomo giada
    gianbattista giancarlo gianfranco gianluca gianluigi gianmarco gianna gianni gianpaolo gianpiero gilberto gina gino gioele giordano
    giovanna girolamo gisella giuditta giuliana giuliano giulio giuseppina grazia graziella guglielmo guido gustavo iacopo ignazio ilario
    immacolata ines iolanda isabella italo ivan ivana ivano ivo jacopo katia lara laura lavinia lea leonardo leone letizia lidia liliana
    lina linda lino livia livio loredana lorena lorella lorenza luana luciana luciano lucrezia ludovica ludovico luigia luisa luisella
    maddalena manuel manuela mara marcella marcello mariangela marianna mariella marina marinella marisa marta martino massimiliano
    matilde mattia maura maurizio mauro melania melissa mirco mirella miriam mirko morena nadia natalia nazario nicoletta nicolo nicolò
    nino noemi norma nunzia nunzio olga ombretta orazio oreste orlando ornella oscar osvaldo ottavia ottavio pamela paride pasquale
    patrizia patrizio pierluigi piera piero pierpaolo pina primo raffaele raffaella raimondo raul rebecca regina remo renata renato renzo
    riccarda rinaldo rita roberta rocco rodolfo rolando romano romeo romina rosalba rosalia rosanna rosario rosaria rosella rossana
    rossella ruggero sabina sabrina samuele sandra sandro sante santina savino saverio serafina serena sergio silvana silvano silvio
    simona simonetta sonia stella susanna tania tatiana teodoro tiziana tiziano tommaso tonino tullio ubaldo ugo umberto valeria valerio
    vanessa vera veronica vilma virginia vito vittoria vittorio viviana walter wanda ylenia zaira
    adam alan albert alexander alfred alice amanda amy andrew anthony arthur ashley barbara benjamin betty brian carol caroline
    catherine christine christopher daniel deborah dennis diane donald donna dorothy douglas edward emma eric eugene evelyn frances frank
    gary george gerald gloria gregory hannah harold helen henry jack jacob jane janet jason jeffrey jeremy joan jonathan joseph joshua
    joyce julia justin katherine kathleen kenneth kevin kimberly larry laurence lawrence lisa louis louise margaret martin matthew megan
    melissa nancy nathan nicholas nicole oliver olivia patricia patrick paul peter philip rachel ralph raymond roger ronald russell ruth
    ryan samantha samuel scott sharon shirley simon stephanie stephen steven susan theresa timothy victoria vincent virginia zachary
    andreas angelika anja annette bernd birgit brigitte christian claudia dieter dirk elke erika ernst felix florian franz friedrich
    gabriele gerhard gisela günter günther hannelore heike heinz helga helmut herbert hermann holger horst johannes josef jörg julian
    jutta karin karl katharina katrin lars lukas manfred markus matthias maximilian monika nina norbert oskar otto petra rainer ralf
    renate rolf rudolf silke stefan susanne thorsten tobias ulrich ute uwe volker werner wilhelm
    adrien agnès alain amélie antoine arnaud aurélie benoît bernard bertrand camille catherine cédric céline chantal christophe claire
    claude clément corinne denis didier dominique élodie émilie étienne fabrice frédéric geneviève gérard gilles guillaume guy hélène
    henri hugo jérôme julie julien laetitia laurent léa luc madeleine marc marcel marguerite marie marion mathieu maxime monique nathalie
    nicolas odile olivier pascal patrice paulette philippe raphaël rémi rené romain sandrine sébastien serge simone stéphane sylvie
    thérèse thierry valérie véronique virginie xavier yann yves yvette
    alejandro alejandra alfonso álvaro ana andrés ángel antonio beatriz blanca catalina consuelo cristóbal diego eduardo elvira
    enrique esteban felipe fernando francisco gabriel gonzalo guadalupe guillermo héctor ignacio inés isabel jaime javier joaquín jorge
    jesús josefa juana julio lourdes lucía luis manuel margarita maría marcos mariano marisol mercedes montserrat nuria pablo paloma
    paula rafael ramón raquel ricardo roberto rocío rodrigo rosario rubén salvador santiago sergio silvia soledad susana teresa tomás
    vicente víctor yolanda""".split()
)

# Titles by kind.
TITLES = {
    "PERSON": "nome|cognome|nome e cognome|cognome e nome|nome cognome|cognome nome|nominativo|name|first name|last name|surname|full name|given name|family name",
    "AZIENDA": "cliente|customer|client|ragione sociale|company|company name",
    "EMAIL": "email|e mail|mail|pec|indirizzo email|indirizzo e mail|email address|e mail address",
    "TELEFONO": "telefono|tel|cellulare|cell|numero di telefono|phone|telephone|mobile|phone number",
    "CF": "codice fiscale|cf|c f|tax code|fiscal code",
    "PIVA": "p iva|piva|partita iva|vat|vat number|vat no|vat id",
    "INDIRIZZO": "indirizzo|address|street address",
}
