"""The small labelled table from which the tagger of personal data is trained.

Each line is a text with labelled slots ({NAME}, {EMAIL}, {PHONE}, {ID}, {ADDR}, ...) and
slots that carry no label ({PLACE}, {FIX}, {N}, ...). ``examples`` fills every line with
invented values several times, which gives the labelled rows; their number is at most
``len(LINES) * fills``. The lines were written for this table; none is taken from a corpus.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Sequence

#: The labelled lines.
LINES = r"""
{NAME} called back an hour later.
{NAME} asked for a second look at the profile view.
{NAME} was the pilot flying.
{NAME} has left the company since.
{NAME} told us that the wheel brakes felt soft.
{NAME} wrote the first draft and never saw the final one.
{NAME} will teach the refresher class in spring.
{NAME} is off duty until Monday.
{NAME} owns the hangar next to the fuel pumps.
{NAME} drew the sketch in the margin.
{NAME} and {NAME} shared the night shift.
{NAME} thinks the note was never printed.
{NAME} sold the aircraft two years ago.
{NAME} answered every question without the manual.
{NAME} had already filed the complaint.
{NAME} joined by phone.
{NAME} took over after lunch.
{NAME}, who was on call, restarted the server.
{NAME}, our chief inspector, refused to sign.
{NAME} (first officer) handled the radio.
{NAME} (maintenance)
{NAME} - night supervisor
{NAME}: please bring the old binder.
{NAME} writes: {LOWSENT}
{NAME} did not attend.
{NAME}'s report came in late.
{NAME}'s logbook was never found.
This was decided by {NAME} alone.
The copilot, {NAME}, lowered the gear by hand.
We spoke to {NAME} about the missing pages.
I met {NAME} at the fly-in last summer.
Ask {NAME} for the keys.
Please give the headset back to {NAME}.
A letter from {NAME} arrived this morning.
The instructor was {NAME}.
Our contact there is {NAME}.
Passenger in the rear seat: {NAME}
Pilot in command: {NAME}
Prepared by {NAME}
Prepared by: {NAME}
Reviewed and approved by {NAME}.
Author: {NAME}
Owner: {NAME}
Attention: {NAME}
From: {NAME}
To: {NAME}
Cc: {NAME}, {NAME}
Name: {NAME}
Student: {NAME}; instructor: {NAME}
Dear {NAME},
Dear {NAME}, thank you for the photographs.
Hello {NAME}, {LOWSENT}
Thanks to {NAME} we found the error.
As {NAME} pointed out, {LOWSENT}
When {NAME} landed, the apron was empty.
If {NAME} agrees, we close the ticket.
Nobody but {NAME} noticed the wrong unit.
She married {NAME} in the same year.
His neighbour {NAME} heard the engine.
The mechanic {NAME} replaced the pump.
Inspector {NAME} found nothing unusual.
Interview with {NAME}, second part.
The club thanks {NAME} and {NAME} for their help.
Those present: {NAME}, {NAME}, {NAME}.
The seat was booked for {NAME}.
On behalf of {NAME}
It was {NAME} who closed the valve.
We waited for {NAME} until ten.
The keys belong to {NAME}; {LOWSENT}
Statement of {NAME}, taken at noon
Training record of {NAME}
Best wishes, {NAME}
Yours, {NAME}
Best wishes,\n{NAME}
Sincerely,\n{NAME}\n{PHONE}
Kind greetings\n\n{NAME}\n{EMAIL}
Many thanks,\n{NAME}, {EMAIL}
Cheers,\n{NAME} | {PHONE}
Thank you\n{NAME}\n{ADDR}
/s/ {NAME}
-- {NAME}
- {NAME}, {PHONE}
***\n{NAME}\n{ADDR}\n{PHONE}
___\n{NAME} | {EMAIL} | {PHONE}
{NAME}\n{PHONE}\n{EMAIL}
{NAME}\n{ADDR}
{NAME}, {ADDR}, {PHONE}
{NAME}, {EMAIL}
{NAME} | {ADDR} | {EMAIL}
{NAME} | {PHONE} | {ADDR}
{NAME} <{EMAILX}>
1. {NAME}, {PHONE}
2. {NAME} ({EMAILX})
The complaint was recorded by {NAME} at the front desk.
They were told by {NAME}, who had seen the old sheet.
In the words of {NAME} the needle swung freely.
The landing was made by {NAME} in the afternoon.
By the account of {NAME} the needle never moved.
In a note to {NAME} the planner explained the delay.
{NAME} saw the lights go out.
{NAME} keeps bees behind the tower.
{NAME} reminded the class of the exam.
{NAME} wants the afternoon slot.
{NAME} lost a glove on the ramp.
{NAME} prefers the other headset.
{NAME} and the mechanic pushed the plane inside.
{NAME}, retired since May, still helps out.
{NAME}, {LOWSENT}
{NAME}. {SENT}
{SENT} {NAME} smiled and said nothing.
{SENT} {NAME} was not told.
{SENT} {NAME} agreed at once.
{SENT} That was {NAME}.
Both {NAME} and the student were unhurt.
Only {NAME} had read the bulletin.
Later {NAME} apologised to the passengers.
Yesterday {NAME} found the missing card.
Then {NAME} switched to the standby radio.
Perhaps {NAME} remembers the frequency.
Where {NAME} stood, the noise was loud.
Did {NAME} ever reply?
Rumour has it that {NAME} is moving.
The examiner, {NAME}, failed three pilots.
The question came from {NAME} in the last row.
A photograph of {NAME} hangs in the hall.
The desk of {NAME} is empty.
Congratulations to {NAME}, {LOWSENT}
Speech by {NAME}
Mechanic on duty: {NAME}.
Submitted: {NAME}
Submitted: {NAME};
Traduit par {NAME}.
Signature : {NAME}
Hier, {NAME} a perdu ses clés.
La question vient de {NAME}, au dernier rang.
Ayer {NAME} perdió sus llaves.
La pregunta fue de {NAME}, en la última fila.
Firma: {NAME}
{NAME} mentioned the broken hinge to the office.
"It felt normal," said {NAME}.
"{SHORT}" says {NAME}.
Witnessed by {NAME} and {NAME}.
Signature of {NAME}
Approved: {NAME}.
Checked: {NAME}; {SENT}
{NAME} a signalé une panne de radio.
{NAME} est absent cette semaine.
{NAME} n'a pas répondu au courrier.
{NAME} et {NAME} ont relu la fiche.
Le commandant {NAME} a demandé un autre créneau.
Le vol a été confié à {NAME}.
Le rapport de {NAME} est arrivé trop tard.
Selon {NAME}, le signal était stable.
Merci à {NAME} pour les photos.
Rédigé par {NAME} mardi matin.
Monsieur {NAME} viendra demain.
Cher {NAME}, voici la nouvelle fiche.
Nom : {NAME}
Auteur : {NAME}.
Lu et approuvé : {NAME}
Cordialement,\n{NAME}
Cordialement,\n{NAME}\n{PHONE}
L'atterrissage fut assuré par {NAME} dans la soirée.
{NAME} pidió una copia del plano.
{NAME} no vino a la reunión.
{NAME} y {NAME} firmaron el acta.
El informe de {NAME} llegó tarde.
Según {NAME}, la señal era débil.
El vuelo quedó a cargo de {NAME}.
El piloto era {NAME}.
Hablamos con {NAME} sobre la pista.
Redactado por {NAME} el martes.
Nombre: {NAME}
Autor: {NAME}.
Estimado {NAME}: {LOWSENT}
Un saludo,\n{NAME}
Atentamente,\n{NAME}\n{EMAIL}
El aterrizaje fue hecho por {NAME}.
La maniobra fue vista por {NAME}, mecánico de guardia.
E-mail: {EMAIL}
e-mail {EMAIL}
Email address: {EMAIL}.
My address is {EMAIL}.
You can reach me via {EMAIL} on weekdays.
The form bounced back from {EMAIL}.
Forward the invoice to {EMAIL} as well.
Applications go to {EMAIL}; {LOWSENT}
{EMAIL} is no longer in use.
{EMAIL} did not get the file.
Sent from {EMAIL} at noon.
Login name {EMAIL}
Someone using {EMAIL} asked for access.
For the photographs ask {EMAIL}.
Reset the password of {EMAIL}, please.
We never got an answer from {EMAIL}.
Two accounts, {EMAIL} and {EMAIL}, share one password.
Drop me a line: {EMAIL}
Questions: {EMAIL} or {PHONE}
Courriel : {EMAIL}
Mon adresse est {EMAIL}.
Répondez à {EMAIL} si la fiche manque.
Transmis à {EMAIL} hier.
Correo: {EMAIL}
Mi correo es {EMAIL}.
Envíe la foto a {EMAIL}, por favor.
El mensaje para {EMAIL} fue devuelto.
Phone: {PHONE}
Phone {PHONE}
Mobile: {PHONE}; {LOWSENT}
My number is {PHONE}.
Fax {PHONE}
Ring {PHONE} before nine.
You may also text {PHONE}.
The duty phone is {PHONE}.
Telephone {PHONE} (day and night)
You will find the night shift at {PHONE} all week.
Reach me at {PHONE} until six.
The shop can be called at {PHONE}.
At {PHONE} nobody picked up.
He is listed under {PHONE} in the old directory.
Messages for the mechanic go to {PHONE} until noon.
The weather line was {PHONE} then.
He gave {PHONE} as his home number.
Her cell is {PHONE}, the office {PHONE}.
Dial {PHONE} and ask for the planner.
The number {PHONE} is out of order.
{PHONE} rang all evening.
For urgent matters: {PHONE}
Call the shop, {PHONE}, for a price.
Call me on {PHONE} for the rest.
Please ring {PHONE} for a new key.
Dial {PHONE} for the hangar.
Voicemail can be left at {PHONE}.
I can be reached on {PHONE} after work.
Try {PHONE} first, then {PHONE}.
Urgent? {PHONE}
ph. {PHONE}
cell {PHONE}
Mon numéro est le {PHONE}.
Téléphone : {PHONE}
Rappelez-moi au {PHONE} ce soir.
Joindre l'atelier au {PHONE}.
Mi número es {PHONE}.
Teléfono: {PHONE}
Llamar al {PHONE} por la tarde.
Me localizan en el {PHONE}.
He travelled on {ID}.
His {ID} expires in {MONTH}.
Her {ID} was stolen.
The clerk copied {ID} by hand.
The card shows {ID} and a photograph.
We hold {ID} for this student.
Identification: {ID}
The applicant gave {ID}.
The applicant gave {ID}, issued in {MONTH}.
Stored with {ID} in the personnel folder.
Under {ID} we have no entry.
{ID} was not in the register.
{ID} belongs to another person.
Please check {ID} once more.
The badge was issued against {ID}.
Both {ID} and {ID} were typed wrongly.
See {ID} (copy attached).
His papers: {ID}.
They asked for {ID} at the gate.
Her social security number is {SSN}.
My SSN is {SSN}.
Social security: {SSN}
SSN {SSN} appears twice in the payroll.
The passport is number {PASS}.
His passport, {PASS}, was issued abroad.
Passport: {PASS}
The number of his passport is {PASS}.
Your passport number, {PASS}, has a typing error.
The visa refers to passport {PASS}, not to the older one.
The clerk wrote {PASS} as the passport number.
Is {SSN} your social security number?
For the tax form she gave her social security number, {SSN}.
The payroll lists the social security number {SSN} for him.
A licence with the number {LIC} was found on the ramp.
The licence number {LIC} is printed too small.
He showed a driver's license, {LIC}, at the desk.
The certificate number, {CERT}, must be on the form.
The examiner noted the certificate number {CERT} by hand.
The national ID is {NAT} in both files.
Her identity number was {NAT}; {LOWSENT}
Passport no. {PASS} was cancelled.
Her pilot certificate is {CERT}.
Certificate {CERT} was suspended in {MONTH}.
The mechanic's certificate number is {CERT}.
Medical certificate no. {CERT}
Driving licence {LIC}
His driver's license number is {LIC}.
Licence: {LIC}; {LOWSENT}
The licence {LIC} lapsed last year.
National number: {NAT}
His national identity number is {NAT}.
National insurance number {NAT}
Taxpayer ID {NAT}
The identity card {NAT} is valid.
La demande porte {ID}.
Son passeport est le {PASS}.
Passeport n° {PASS}
Numéro de sécurité sociale : {NAT}
Carte d'identité {NAT}
Permis de conduire {LIC}, perdu hier.
La solicitud lleva {ID}.
Su pasaporte es el {PASS}.
Pasaporte {PASS}
Número de la seguridad social: {NAT}
DNI {NAT}
Licencia de piloto {CERT}, vigente.
I live at {ADDR}.
He moved to {ADDR} in {MONTH}.
Her house is {ADDR}, near the church.
The office is at {ADDR}.
Send the invoice to {ADDR}.
Send the invoice to {ADDR}; {LOWSENT}
Home address: {ADDR}
Address: {ADDR}
Postal address {ADDR}
Parcels go to {ADDR}. {SENT}
The owner is registered at {ADDR}.
She was born at {ADDR}.
Visitors should come to {ADDR} before nine.
The reporter spent the night at {ADDR} and heard nothing.
The crew slept at {ADDR} during the inspection.
Leave the binder at {ADDR}; {LOWSENT}
The car was parked outside {ADDR} all night.
The headset was left at {ADDR}.
We rent a room in {ADDR}.
{ADDR} is for sale.
{ADDR} was searched twice.
Return to: {ADDR}
From {ADDR} it is a short walk to the gate.
Noise complaint from {ADDR}
The caller lives in {ADDR} and heard two engines.
They delivered the parcel to {ADDR} by mistake.
The family at {ADDR} asked for quiet nights.
J'habite {ADDR}.
Son bureau est au {ADDR}.
Adresse : {ADDR}
Envoyez le colis au {ADDR}.
Le voisin du {ADDR} s'est plaint.
Il loge au {ADDR} depuis lundi.
Mi casa está en {ADDR}.
Dirección: {ADDR}
Mande el paquete a {ADDR}.
El vecino de {ADDR} se quejó.
Se aloja en {ADDR} desde el lunes.
Departures from {PLACE} are handled by the next sector.
Near {PLACE} the road is flooded.
The hills around {PLACE} are higher than charted.
Flights over {PLACE} stay above {ALT}.
We drove to {PLACE} and back.
No one lives in {PLACE} any more.
Radar coverage toward {PLACE} is poor, and {PLACE} has none.
The lights of {PLACE} could be seen from {PLACE}.
A fire burnt at {PLACE}, and smoke was reported at {PLACE}.
On the way from {PLACE} to {PLACE} the icing stopped.
The tower at {PLACE} opens at {HOUR}.
{PLACE} keeps two fire trucks; {LOWSENT}
{PLACE}: {LOWSENT}
For {PLACE}, {LOWSENT}
At {PLACE}, {LOWSENT}
{SENT} The same holds for {PLACE}.
{SENT} It was so at {PLACE} too.
{PLACE} was evacuated during the fire.
{PLACE} lost power at {HOUR}.
{PLACE} and {PLACE} share one fire truck.
We diverted to {PLACE} and waited {N} minutes for fuel.
A new mast stands {N1} miles west of {PLACE}.
The air show at {PLACE} was cancelled.
Crews based at {PLACE} asked for a longer rest.
Visitors to {PLACE} need a vest on the apron.
Between {PLACE} and {PLACE} the valley is often in fog.
The weather station of {PLACE} sends a reading every hour.
The museum beside {PLACE} shows an old beacon.
Bird activity was seen at {PLACE}, {PLACE} and {PLACE}.
Simulator data for {PLACE} arrived late.
{ORG} will paint the hangar in {MONTH}.
{ORG} bought two more trainers.
The contract with {ORG} ends in {MONTH}.
A crew of {ORG} took the wrong taxiway.
The {TYPE} needs a longer runway.
A {TYPE} blocked the intersection for {N} minutes.
Two {TYPE} aircraft were parked on the grass.
See the Chart Supplement and the Aeronautical Information Manual for details.
Missed Approach Procedure, Revision {N2}
Section {N1}: Approach Minimums
Appendix B, Table {N1}
On {DAY} the ramp was closed; on {DAY} it was open again.
In {MONTH} the beacon was moved, in {MONTH} it was moved back.
Hold short of taxiway Alpha, then follow Bravo to the ramp.
Squawk {N4} and say again your position.
Tune {FREQ} for the weather, {FREQ} for ground.
The tower listens on {FREQ}; clearance is {FREQ}.
Runway {N2}L is {N4} feet long and {N3} feet wide.
Runway {N2} and runway {N2}R cross near the fire station.
Work order {N8} is still open.
Taxiway {LETTER} is closed, taxiway {LETTER} is open again.
Class {LETTER} airspace begins above {ALT}.
Exit {LETTER} only (north side); {LOWSENT}
Option {LETTER} costs more than option {LETTER}.
Hangar {LETTER} has no heating.
Stand {LETTER}. Here {LOWSENT}
Aircraft of group {LETTER} must use the long runway.
The note holds for group {LETTER} only.
Part number {PART} fits both pumps.
We ordered {PART} and got {INDEX}.
Index {INDEX} of the folder is missing.
Its stock number is {INDEX}, the old one was {PART}.
The number on the label is {PART} and the drawing is {INDEX}.
Drawing {INDEX} and model {PART} don't match.
The file number is {INDEX}; {LOWSENT}
The sheet carries the number {INDEX}, the next one {PART}.
The serial number is {N8}.
Invoice {N6} of {MONTH} was paid twice.
Tail number {TAIL} is painted under the wing.
{TAIL} departed first, {TAIL} ten minutes later.
Flight {N4} was delayed by {N} minutes.
Flights {N3} and {N4} swapped gates.
The point lies at N{N2}{N2}{N2} W0{N2}{N2}{N2}.
Position N{N2} {N2}.{N1}, W{N2} {N2}.{N1}
Elevation {N4} feet, variation {N2} degrees east.
At {HOUR} the wind was {N3} at {N2} knots.
Pressure fell from 30.{N2} to 29.{N2} by {HOUR}.
{FIX} is {N1} miles from {FIX} on the {N3} course.
After {FIX} expect {FIX}, then {FIX}.
{FIX} and {FIX} have swapped places on the map.
The {CODE} beacon is silent.
Track the {CODE} signal until {FIX}, then descend to {ALT}.
Descend to {ALT} at {FIX} and hold as published.
Leave {ALT} for {ALT} over {FIX}@{ALT}.
Climb at {N3} feet per mile until {ALT}.
Report {CODE}@{N2}.{N1} outbound, then {CODE}@{N1}.{N1} inbound.
Turn at {CODE}@{N2}.{N1} and slow down.
Descend so as to meet {FIX} @ {ALT} or lower.
Level off {FIX} @ {ALT}; {LOWSENT}
Bulletin {CODE} {N1}/{N4} cancels {CODE} {N1}/{N4} of last week.
{CODE} {N1}/{N4} is no longer valid.
Leave {FIX} toward {FIX} and forget {FIX}.
The arrival crosses {FIX} because {FIX} is too close to the city.
The crew reported that {CODE} was off the air.
Dispatch believes that J{CODE} has no alternate.
A leg from {FIX} to {FIX} was redrawn.
Join {FIX} from the south.
Circuits at J{CODE} are flown to the left.
No traffic was seen around J{CODE} or {FIX}.
The {CODE} VORTAC and the {CODE} NDB are checked every year.
Reference {CODE}-{N3}, sheet {N2} of {N2}
Form {N4}-{N1} replaces form {N4}.
Amendment {N1}A and amendment {N2} differ in one line.
Cycle {N4} has {N3} changed records.
Copies of bulletin {N4}-{N2} hang in the crew room.
The road to Terminal {N1} and the drive behind hangar {N2} are closed.
{N3} meters of fence along the road were replaced.
{N2} square miles of forest burnt near {PLACE}.
{N3} Main gear tires were scrapped.
Gate {N2} Court side, gate {N2} Street side
{N4} feet of runway remain; {N2} feet are closed.
A circle of {N2} miles around {PLACE} is restricted.
Item {N2}: {LOWSENT}
Note {N2}: {LOWSENT}
Note that {LOWSENT}
After the storm, {LOWSENT}
In short, {LOWSENT}
For J{CODE}, {LOWSENT}
At J{CODE}, {LOWSENT}
The rule was written for J{CODE}, {LOWSENT}
Toward {FIX}, {LOWSENT}
As seen from {PLACE}, {LOWSENT}
South of {PLACE}, {LOWSENT}
{SENT} [see {CODE}-{N3}]
{SENT} (sheet {N3})
{SENT} {SENT}
{SENT}\n{SENT}
{SENT}\n\n{SENT}
{SENT} {SENT} {SENT}
La balise {CODE} ne répond plus depuis {HOUR}.
Le terrain de {PLACE} ferme à {HOUR}.
La tour écoute sur {FREQ} le dimanche.
Montez à {ALT} pieds après {FIX}.
La piste {N2} mesure {N4} pieds.
Le stationnement près de {PLACE} est gratuit.
La page {N2} manque dans le dossier {N4}.
Trois avions attendaient à {FIX} vers {HOUR}.
La radiobaliza {CODE} dejó de emitir a las {HOUR}.
El campo de {PLACE} cierra a las {HOUR}.
La torre escucha en {FREQ} los domingos.
Ascienda a {ALT} pies después de {FIX}.
La pista {N2} mide {N4} pies.
Falta la página {N2} del manual {N4}.
Tres aviones esperaban en {FIX} a las {HOUR}.
El hangar de {PLACE} se vendió en {MONTH}.
""".strip().split("\n")

#: Sentences without personal data.
SENTENCES = """
The windsock was torn during the night.
Nobody had updated the binder in the crew room.
Crews may skip the second briefing if the first one was complete.
The left engine ran rough above cruise power.
Rain had washed the paint off the threshold.
Student pilots often forget to set the second altimeter.
Our printer cuts off the bottom line of every page.
Every scanned page must be compared with the original by hand.
The fuel truck needs a new hose before winter.
Two deer crossed the taxiway at dusk.
Ground power was not available on the north ramp.
The simulator froze after the third stall.
Turbulence was moderate below the ridge.
The checklist has eleven items, but the card shows nine.
Pilots reported a smell of burnt rubber.
The parser dropped the last leg whenever a line was empty.
Half of the answers could not be read.
An automatic message told everyone that the link was down.
The radio altimeter disagreed with the chart by a few feet.
Coffee is free until the end of the month.
Please close the hangar door behind you.
The old map used a different scale.
Snow was cleared twice before noon.
Night landings need a working landing light.
The descent was steeper than the book allows.
Headings are magnetic unless the sheet says otherwise.
Most of the delay came from de-icing.
A dead battery kept the door locked.
The trainer explained the turn with a toy plane.
Our test set is too small for a firm answer.
The second model guessed the altitude from the title.
Parking is limited to three days.
Low clouds hid the upper half of the tower.
The alarm rang for no reason and stopped by itself.
Wake turbulence from the heavy jet was felt on short final.
The brake pedal was stiff and had to be pumped.
Minimums were raised because of a crane.
The crew read back the wrong level and was corrected.
Speed was reduced early to let a slower aircraft land.
Most questions in the survey had one clear answer.
We counted each record once, even if it was delivered twice.
The tape of that hour was erased.
Grass was mown between the lights.
Birds nest under the eastern roof.
A fuse blew when the heater was switched on.
The exam has forty questions and takes two hours.
The new antenna works well in the rain.
The taxiway signs will be replaced next week.
Les équipages ont trouvé la fiche trop sombre.
Le vent a tourné pendant la nuit.
La radio grésille dès que le moteur tourne.
Le prochain cours aura lieu après les vacances.
Une page du manuel est restée dans l'imprimante.
Le givre a bloqué la porte du hangar.
La lluvia borró las marcas de la plataforma.
El motor izquierdo vibraba al despegar.
La impresora corta la última línea de cada hoja.
El próximo curso empieza después de las fiestas.
Los alumnos olvidan a menudo el segundo altímetro.
El viento cambió durante la noche.
""".strip().split("\n")

#: Invented or common names, places, streets, firms, aircraft and mail hosts for the slots.
GIVEN = "Aaron Adele Agnes Aisha Albert Alice Amara Ana Andrea Andrei Anna Anton Astrid Beatrice Bernard Bo Brigitte Bruno Camille Carlos Carmen Cecilia Chidi Chloe Claire Clara Daniel David Deborah Diego Dmitri Dolores Ed Edith Elena Elias Elsa Emilio Enrique Erik Esther Eva Fatima Felix Fernando Florence Frank Gabriel George Gina Gloria Goran Grace Gunnar Hannah Hans Helen Henri Hiroshi Hugo Ibrahim Ingrid Irene Isabel Ivan Jack Jacques Jamal James Javier Jean Jean-Paul Joanna John Jonas Jorge Jose Juan Julia Karim Karin Karl Keiko Kenji Kevin Klara Kofi Lars Laura Leila Leo Linda Louis Lucia Luis Magda Manuel Mara Marco Margaret Maria Marie-Claire Marta Martin Mary Matthew Mei Michael Miguel Monica Nadia Nicolas Nils Nora Olga Oliver Omar Oscar Pablo Paul Pedro Peter Philip Pierre Priya Quentin Rachel Rafael Ramon Rebecca Richard Robert Rosa Ruth Samuel Sandra Sara Sergei Simon Sofia Sonia Stefan Steven Susan Sven Tanya Teresa Tessa Thomas Tomas Uma Ursula Valerie Vera Victor Viktor Walter Wanda Wei Willem William Xavier Ximena Yusuf Yvonne Zara Zoltan".split()
FAMILY = "Abbott Achterberg Adeyemi Bergstrom Blackwood Carmichael Castellano Chaudhry D'Angelo Dellacroce Desrosiers Dunmore Eriksen Etcheverry Falconer Fitzwarren Fontaine Garcia-Lopez Greenhalgh Gustafson Hathersage Hollander Ibarra Ironmonger Jankowski Jovanovic Kellerman Kowalczyk Li Lindholm Lloyd-Webber Lombardi Longbottom MacAllister Marchetti Mbeki McTavish Mortensen Nakamura Novakova O'Connell O'Hara Okafor Ostrander Oyelaran Pemberton Petrovic Quiroga Rasmussen Ravensdale Rosenbaum Sakamoto Silverberg Smith-Jones Sorensen Steinhauer Szabo Tanaka Thistlewood Tremblay Underhill Valdivia Vandermeer Wetherby Whitlock Wojcik Yamamoto Yildirim Zimmerman Zubiri de~Souza de~Witt van~Dyke von~Arnim de~la~Cruz".split()
TITLES = "Ms Mr Mrs Mr. Mrs. Dr. Dr Capt. Capt. Capt. Captain Prof. Miss Sgt. Lt. Mme M. Sra. Sr. Señor Herr".split()
PLACES = "Amber Hollow|Bracken Point|Castor Plains|Dorrit Ferry Field|Eldon Marsh|Fallow Crossing|Gideon Marwick Airpark|Harlan Voss Memorial Airport|Iron Gulch|Juno Bluff|Kelso Harbor|Lower Marram|Milford Regional|New Tarrow Heights|Old Stannard Ridge|Pine Saddle|Rook Landing|Silas Thorne Field|Tilden Gap|Upper Wick|Vesper Bay|Wester Fold|Marrowdale|Quillmere|Hazel Tor|Ansgar Dell|Merritt Fork|Copper Spur|Rowan Notch|Thane Wold|Tern Flats|Sorrel Furrow|Bramley Brook Field|Corwen Crook|Ashdown County Airport|Lake Orrin|Mount Calder|Port Selwyn|Saint Osric|North Tamsin Municipal|Basil Fenner International Airport|Edda Rauch Field|Martin Sayle Heliport|Clara Wend Airfield|Jonas Pike Airstrip|Oakley|Brimfold|Sandwick|Two Rivers Airport|Ebbing Cove|Drummond Tower|Cobb Valley|Larch Canyon|Stillwater Mesa".split("|")
ORGANISATIONS = "Blue Heron Air|Tamarack Charter|Northwind Cargo|Pelican Flight School|Granite Avionics|Crestline Airways|Harbor Helicopters|Summit Aero Club|Juniper Survey Company|Delta Ramp Services".split("|")
AIRCRAFT = "Cessna Caravan|Piper Arrow|Beech Baron|Twin Otter|Pilatus Porter|Cessna 172|Airbus 320|King Air 200|Learjet 45|Diamond Star".split("|")
STREETS = "Birch Hollow|Cedar|Chapel Hill|Dogwood Trail|Elm|Foundry|Granite Ridge|Hickory|Ivy Bank|Kiln|Lantern|Maple Grove|Millstone|North Gate|Orchard|Pewter|Quarter Mile|River Bend|Stone Bridge|Tinker|Upper Meadow|Vine|Walnut|Weaver|Old Mill|Old Post|High|Church Hill|Sunny Bank|Long Meadow|Old Station|Main|Second|Fifth|Harbour|Saddler|West|Lake|Jefferson|Mercer|Queen|Blackthorn".split("|")
WAYS = "Street Street Road Road Rd Lane Lane Ave Avenue Blvd Boulevard St. Court Drive Drive Terrace Way Place Crescent Close Row Parkway Highway Circle Trail Pike Loop Path Square".split()
CITIES = "Ashford Bellmere Cranfield Dunwich Eastbrook Fairhaven Glenrock Hartsel Kingsbury Melrose North~Haven Port~Linden Rosedale West~Abbot Marsh~End".split()
RUES = "rue des Tilleuls|rue de la Gare|rue du Vieux Pont|rue des Lilas Blancs|rue de l'Église|rue du Marché|avenue de la République|boulevard Carnot|chemin des Vignes|impasse du Moulin|route de Lyon|place du Château|quai des Brumes|allée des Chênes".split("|")
CALLES = "Calle del Río Seco|Calle de la Fuente|Calle Mayor|Calle del Pino Alto|Calle de los Olmos|Avenida de la Paz|Paseo del Prado|Plaza Nueva|Camino Viejo|Carretera de Toledo|Carrera 15".split("|")
HOSTS = "mailbox.example|corp.example.com|desk-two.example.org|office.lakeside.example|news.example.net|airclub.example|mail.north.example.org".split("|")
MONTHS = "January February March April May June July August September October November December".split()
DAYS = "Monday Tuesday Wednesday Thursday Friday Saturday Sunday".split()
QUOTES = "no light at all|we turned early|all was quiet|the gear was down|nothing moved".split("|")


def _digits(r: random.Random, form: str) -> str:
    return re.sub("9", lambda _: str(r.randint(0, 9)), form)


def _coded(r: random.Random, forms: str) -> str:
    """One of the forms: 9 becomes any digit, X any capital."""
    return re.sub("X", lambda _: r.choice("ABCDEFGHJKLMNPRSTUVWXYZ"), _digits(r, r.choice(forms.split("|"))))


class Filler(random.Random):
    """Chooses values for slots: names of the given ``part`` (0 or 1, by turns; None for all of them)."""

    def __init__(self, seed: int, part: int | None = None):
        super().__init__(seed)
        step = slice(None) if part is None else slice(part, None, 2)
        self.given, self.family = GIVEN[step], FAMILY[step]


def _name(r: Filler) -> str:
    given, family = r.choice(r.given), r.choice(r.family).replace("~", " ")
    initial = r.choice("ABCDEFGHJKLMNPRSTUVWY")
    kind = r.random()
    if kind < 0.36:
        return f"{given} {family}"
    if kind < 0.46:
        return f"{family}, {given}"
    if kind < 0.6:
        return f"{r.choice(TITLES)} {family}"
    if kind < 0.64:
        return f"{r.choice(TITLES)} {given} {family}"
    if kind < 0.76:
        return f"{initial}. {family}"
    if kind < 0.87:
        return f"{given} {initial}. {family}"
    if kind < 0.89:
        return f"{given} {r.choice(r.given)} {family}"
    if kind < 0.9:
        return f"{given} {family} {r.choice(['Jr.', 'III'])}"
    return (f"{given} {family}".lower, f"{given} {family}".upper)[r.random() < 0.5]()


def _plain_email(r: Filler) -> str:
    given, family, host = r.choice(r.given).lower(), re.sub(r"\W", "", r.choice(r.family)).lower(), r.choice(HOSTS)
    local = r.choice([f"{given}.{family}", f"{family}_{given}{r.randint(10, 99)}", f"{family}-{given[0]}", f"{given[0]}{family}", f"{given}+charts", f"{family}{r.randint(1, 999)}", given])
    return f"{local}@{host}"


def _email(r: Filler) -> str:
    plain = _plain_email(r)
    local, host = plain.split("@")
    spelt = [f"{local} (at) {host}", f"{local} @ {host}", f"{local} [at] {host.replace('.', ' [dot] ')}", f"{local} [at] {host.replace('.', ' [dot] ')}", f"{local} (at) {host}", f"{local} at {host.replace('.', ' dot ')}"]
    return r.choice([plain] * 6 + [f"<{plain}>"] * 2 + [f"mailto:{plain}", plain.upper(), *spelt])


_PHONES = "999-999-9999|(999) 999-9999|999.999.9999|+1 999 999 9999|9999999999|+44 99 9999 9999|+44 9999 999999|+33 9 99 99 99 99|99 99 99 99 99|1-999-999-9999 ext. 99|999-999-9999 x999|999 / 999 99 99|+34 999 99 99 99|+49 99 9999999|(999)999-9999|1 999 999 9999|999-9999"
_SSN = "999-99-9999|999-99-9999|999 99 9999|999999999"
_PASSPORT = "X9999999|XX9999999|XX 999 9999|999999999|X99999999"
_CERTIFICATE = "9999999|#9999999|XX-999999|999999-X|X9999999"
_LICENCE = "X999-9999-9999|X9999999|99-999-9999|XXX999999|9999999-X"
_NATIONAL = "99-999999-X|XX 99 99 99 X|99999999-X|99999999X|9 99 99 99 999 999 99|X-9999999-X"


def _id(r: random.Random) -> str:
    word, forms = r.choice(
        [("passport", _PASSPORT), ("passport number", _PASSPORT), ("passport no.", _PASSPORT), ("Passport", _PASSPORT), ("SSN", _SSN), ("ssn:", _SSN), ("social security number", _SSN), ("social security no.", _SSN)]
        + [("national ID", _NATIONAL), ("national number", _NATIONAL), ("national insurance number", _NATIONAL), ("ID card", _NATIONAL), ("DNI", _NATIONAL), ("pilot certificate", _CERTIFICATE), ("airman certificate no.", _CERTIFICATE)]
        + [("mechanic certificate", _CERTIFICATE), ("medical certificate number", _CERTIFICATE), ("driver's licence", _LICENCE), ("driver's license", _LICENCE), ("licence number", _LICENCE), ("pilot licence", _LICENCE), ("license no.", _LICENCE)]
    )
    return f"{word} {_coded(r, forms)}"


def _address(r: random.Random) -> str:
    number = r.randint(1, 190)
    if (kind := r.random()) < 0.14:
        text = f"{number}{r.choice([' bis', '', '', ' ter'])}{r.choice([',', ''])} {r.choice(RUES)}"
        return f"{text}, {_digits(r, '99999')} {r.choice(CITIES).replace('~', ' ')}" if r.random() < 0.3 else text
    if kind < 0.28:
        return f"{r.choice(CALLES)}{r.choice([',', '', ''])} {number}" + r.choice(["", "", f", {r.randint(1, 9)}º {r.choice('ABCD')}"])
    number = str(r.randint(1, 9999))
    if r.random() < 0.2:
        number = f"{number}-{int(number) + 2}"
    text = f"{number} {r.choice(['', '', '', 'N. ', 'S. ', 'W. ', 'East '])}{r.choice(STREETS)} {r.choice(WAYS)}"
    if r.random() < 0.12:
        text = f"{r.choice(['Unit', 'Apt', 'Suite', 'Flat'])} {r.randint(1, 40)}, {text}"
    if r.random() < 0.15:
        text += f", {r.choice(['Apt', 'Apt.', 'Unit', 'Suite'])} {r.randint(1, 40)}{r.choice(['A', 'B', ''])}"
    if r.random() < 0.6:
        text += f", {r.choice(CITIES).replace('~', ' ')}"
        if r.random() < 0.5:
            text += _digits(r, " 99999")
    return text.upper() if r.random() < 0.06 else text


def _fix(r: random.Random, n: int = 5) -> str:
    return "".join(r.choice("AEIOU" if i % 2 else "BDFGHJKLMNPRSTVWXZ") for i in range(n))


LABELS = {
    "NAME": _name,
    "EMAIL": _email,
    "EMAILX": _plain_email,
    "PHONE": lambda r: _coded(r, _PHONES),
    "ID": _id,
    "SSN": lambda r: _coded(r, _SSN),
    "PASS": lambda r: _coded(r, _PASSPORT),
    "CERT": lambda r: _coded(r, _CERTIFICATE),
    "LIC": lambda r: _coded(r, _LICENCE),
    "NAT": lambda r: _coded(r, _NATIONAL),
    "ADDR": _address,
}
PLAIN = {
    "PLACE": lambda r: r.choice(PLACES),
    "ORG": lambda r: r.choice(ORGANISATIONS),
    "TYPE": lambda r: r.choice(AIRCRAFT),
    "FIX": _fix,
    "CODE": lambda r: _fix(r, 3),
    "ALT": lambda r: str(r.randint(5, 120) * 100),
    "FREQ": lambda r: _digits(r, "1") + str(r.randint(18, 36)) + "." + r.choice(["025", "125", "350", "475", "600", "875", "500"]),
    "PART": lambda r: _digits(r, r.choice(["999-9999-999", "99-99999", "9999-99"])),
    "INDEX": lambda r: _digits(r, r.choice(["555-9999-99", "99.999.99", "9999/99"])),
    "TAIL": lambda r: _coded(r, "N999XX|N9999X|X-XXXX"),
    "HOUR": lambda r: f"{r.randint(0, 23):02d}{r.choice(['00', '30'])}",
    "MONTH": lambda r: r.choice(MONTHS),
    "DAY": lambda r: r.choice(DAYS),
    "LETTER": lambda r: r.choice("ABCDEFGH"),
    "SHORT": lambda r: r.choice(QUOTES),
    "N": lambda r: str(r.randint(2, 90)),
    "SENT": lambda r: r.choice(SENTENCES),
    "LOWSENT": lambda r: (lambda s: s[0].lower() + s[1:])(r.choice(SENTENCES)),
    **{f"N{k}": (lambda k: lambda r: _digits(r, "9" * k))(k) for k in (1, 2, 3, 4, 6, 8)},
}

#: Kinds of personal data by label.
KINDS = {"EMAIL": "email", "EMAILX": "email", "PHONE": "phone", "ADDR": "street_address", "NAME": "person_name"} | dict.fromkeys(("ID", "SSN", "PASS", "CERT", "LIC", "NAT"), "identity_number")

_WORDS = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
#: Words of the values themselves.
_OWN = "unit apt suite flat bis ter jr iii ext x n s w east ssn social security passport national id card insurance pilot airman mechanic medical certificate number no driver's licence license dni mailto at dot"
#: Words that make a name a place's or a firm's.
_PLACE = "field airport airpark airfield airstrip heliport international regional municipal memorial county tower bay cove valley canyon mesa lake mount port saint air airways charter cargo club company services school at near in from over around toward towards between beyond above vers près cerca desde hacia sobre"


def literal_words(lines: Sequence[str] = (), reach: int = 3, least: int = 3) -> set[str]:
    """Words (in lower case) whose identity may count as a feature: those that stand within ``reach``
    words of a labelled slot, or two of a place, in ``least`` lines or more, and those that belong
    to the values themselves. All other words are known by their shape only, as most words of a
    corpus are."""
    streets = " ".join([*WAYS, *(x.split(" ")[0] for x in RUES + CALLES), "de des del du la le les los las l'"])
    near = {w.lower() for w in _WORDS.findall(" ".join([*TITLES, streets, _OWN, _PLACE]))}
    seen: Counter = Counter()
    for line in lines or LINES:
        parts = re.findall(r"\{\w+\}|" + _WORDS.pattern, line.replace("\\n", " "))
        beside: set[str] = set()
        for i, part in enumerate(parts):
            if part[1:-1] in LABELS or part == "{PLACE}":
                far = reach if part[1:-1] in LABELS else 2
                beside |= {w.lower() for w in parts[max(0, i - far) : i + far + 1] if not w.startswith("{")}
        seen.update(beside)
    return near | {w for w, n in seen.items() if n >= least}


#: Words for a line's own ones where an example shows a value in strange company.
_ANY = sorted({w for x in SENTENCES for w in re.findall(r"\b[^\W\d_]{2,}\b", x) if w.islower()})


def _fill(r: Filler, line: str, strange: float = 0.0) -> tuple[str, list[tuple[int, int, str]]]:
    """The line with its slots filled; with ``strange``, that share of its own words is put by chance."""
    text, spans = "", []
    if strange:
        own = lambda m: r.choice(_ANY) if r.random() < strange else m.group()
        parts = re.split(r"(\{\w+\}|\\n)", line)
        line = "".join(x if i % 2 else re.sub(r"(?<!['’])\b[^\W\d_]{2,}\b", own, x) for i, x in enumerate(parts))
    for part in re.split(r"(\{\w+\})", line.replace("\\n", "\n")):
        slot = part[1:-1] if part.startswith("{") else None
        if slot in LABELS:
            value = LABELS[slot](r)
            spans.append((len(text), len(text) + len(value), KINDS[slot]))
            text += value
        elif slot:
            text += PLAIN[slot](r)
        else:
            text += part
    return text, spans


def _restyled(r: Filler, text: str) -> str:
    """Plain text as documents also write it: titled, in capitals or small letters, quoted or marked."""
    kind = r.random()
    if kind < 0.06:
        return text.title()
    if kind < 0.1:
        return text.upper()
    if kind < 0.12:
        return text.lower()
    if kind < 0.15:
        words = text.split(" ")
        return "> " + " ".join(words[: len(words) // 2]) + "\n> " + " ".join(words[len(words) // 2 :])
    return f"**{text}**" if kind < 0.17 else text


#: Shares of a labelled line's words that are put by chance, one for each example: values must be known by themselves too.
STRANGE = (0.0, 0.0, 0.0, 0.5, 0.9)


def is_labelled(line: str) -> bool:
    return any(f"{{{k}}}" in line for k in LABELS)


def examples(fills: int = 8, seed: int = 11, lines: Sequence[str] = (), part: int | None = None, strange: Sequence[float] = STRANGE) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Texts with the (start, end, kind) of their personal data: every labelled line, ``fills``
    times, among lines without any, as in a document. ``lines`` are all of ``LINES`` by default;
    ``part`` takes every other name only, to hold out the rest, and ``strange`` are the shares of
    its words that a line may lose to others."""
    r = Filler(seed, part)
    lines = list(lines) or LINES
    plain = [x for x in lines if not is_labelled(x)] + SENTENCES
    out = []
    for line in lines:
        for _ in range(fills if is_labelled(line) else max(1, fills // 4)):
            parts = [r.choice(plain) for _ in range(r.randint(0, 2))] + [line] + [r.choice(plain) for _ in range(r.randint(0, 1))]
            joint = r.choice([" ", "\n", "\n\n"])
            text, spans = "", []
            for k, x in enumerate(parts):
                more, own = _fill(r, x, r.choice(strange) if is_labelled(x) else 0.0)
                if not own:
                    more = _restyled(r, more)
                if k:
                    text += joint if r.random() < 0.8 else r.choice(["\n", "\n\n", " "])
                spans += [(s + len(text), e + len(text), kind) for s, e, kind in own]
                text += more
            out.append((text, spans))
    return out
