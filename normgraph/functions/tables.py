"""Tables of the registry: rules, incidents and dictionaries.  They are data, not derived from anything."""

from __future__ import annotations

# Compliance rules by sector: status, title, what it says and what to do.
COMPLIANCE = [
    ("fintech", "covered", "UU PDP Ps. 16-23 (Prinsip Pemrosesan Data)", "Pemrosesan data nasabah wajib memiliki dasar hukum yang sah. Relevan untuk setiap pemrosesan data oleh AI.", "Pastikan data nasabah yang diproses AI memiliki dasar hukum eksplisit (persetujuan/kontrak/kewajiban hukum)."),
    ("fintech", "partial", "POJK 11/2022 Manajemen Risiko TI", "Mengatur manajemen risiko teknologi informasi perbankan. Berlaku namun tidak spesifik untuk AI.", "Interpretasikan ketentuan \"sistem yang berdampak material\" sebagai mencakup model AI Anda."),
    ("fintech", "partial", "POJK 77/2016 Peer-to-Peer Lending", "Berlaku untuk fintech lending. Tidak mengatur algoritma credit scoring secara spesifik.", "Dokumentasikan metodologi credit scoring sebagai bagian dari prosedur operasional yang wajib dilaporkan."),
    ("fintech", "gap", "⚠️ Sandbox Regulasi AI Keuangan", "BELUM ADA regulasi yang memungkinkan pengujian inovasi AI keuangan dalam lingkungan terkontrol.", "Advokasikan ke OJK untuk framework sandbox AI. Sementara itu, lakukan self-governance dan dokumentasi uji coba."),
    ("fintech", "gap", "⚠️ Kewajiban Audit Bias Algoritma", "BELUM ADA kewajiban hukum untuk mengaudit bias dalam model credit scoring.", "Lakukan internal bias audit secara berkala. Persiapkan dokumentasi untuk kemungkinan regulasi mendatang."),
    ("facial", "partial", "UU PDP Ps. 26 (Data Biometrik Sensitif)", "Data wajah dikategorikan sebagai data sensitif berdasarkan UU PDP. Membutuhkan izin eksplisit.", "Dapatkan persetujuan eksplisit tertulis sebelum mengumpulkan dan memproses data wajah."),
    ("facial", "partial", "PP PSTE 71/2019 Ps. 28 (Keamanan SE)", "Sistem elektronik wajib memenuhi standar keamanan. Berlaku untuk sistem FR sebagai PSE.", "Implementasikan enkripsi data biometrik at-rest dan in-transit, lakukan security audit berkala."),
    ("facial", "gap", "⚠️ Izin Penggunaan FR di Ruang Publik", "BELUM ADA regulasi yang mengatur penggunaan facial recognition di ruang publik.", "Adopsi prinsip \"Privacy by Design\" secara sukarela. Hindari penggunaan FR untuk mass surveillance."),
    ("facial", "gap", "⚠️ Standar Akurasi & Anti-Bias FR", "BELUM ADA standar teknis akurasi dan anti-diskriminasi untuk sistem FR di Indonesia.", "Patuhi standar internasional (NIST Face Recognition Vendor Test). Uji akurasi untuk semua kelompok demografis."),
    ("ecommerce", "covered", "UU Perdagangan Ps. 65 (Informasi Produk)", "Wajib memberikan informasi produk yang benar dalam transaksi elektronik.", "Pastikan rekomendasi AI tidak menyesatkan konsumen tentang kualitas atau harga produk."),
    ("ecommerce", "partial", "UU Perlindungan Konsumen Ps. 7", "Pelaku usaha wajib memberikan informasi yang benar, jelas, dan jujur.", "Interpretasikan sebagai kewajiban transparansi minimal tentang cara kerja sistem rekomendasi Anda."),
    ("ecommerce", "gap", "⚠️ Kewajiban Transparansi Algoritma Ranking", "BELUM ADA kewajiban mengungkap faktor penentu ranking produk kepada merchant.", "Terapkan prinsip transparency secara sukarela: informasikan merchant tentang faktor yang mempengaruhi ranking."),
    ("ecommerce", "gap", "⚠️ Larangan Self-Preferencing", "BELUM ADA regulasi yang melarang platform memprioritaskan produknya sendiri di algoritma.", "Siapkan dokumentasi untuk membuktikan netralitas algoritma. Kembangkan mekanisme naik banding merchant."),
    ("content", "partial", "UU ITE Ps. 27A (Konten Asusila)", "Melarang konten asusila. Berlaku untuk deepfake asusila namun sulit pembuktiannya.", "Implementasikan content moderation aktif dan mekanisme pelaporan konten deepfake non-konsensual."),
    ("content", "partial", "UU ITE Ps. 28 (Informasi Bohong)", "Melarang penyebaran informasi bohong. Dapat diterapkan pada deepfake politik.", "Terapkan sistem deteksi otomatis konten deepfake dan label mandatory pada konten AI."),
    ("content", "covered", "UU Hak Cipta Ps. 9 (Hak Ekonomi)", "Melindungi karya cipta. Konten AI yang menggunakan dataset berhak cipta harus diperhatikan.", "Pastikan tidak menggunakan data berhak cipta untuk training tanpa lisensi yang tepat."),
    ("content", "gap", "⚠️ Kewajiban Label/Watermark Konten AI", "BELUM ADA kewajiban hukum pelabelan konten yang dihasilkan AI.", "Terapkan watermark/metadata secara sukarela. Ikuti standar C2PA (Coalition for Content Provenance)."),
    ("content", "gap", "⚠️ Akuntabilitas Penyedia Model Generatif", "BELUM ADA regulasi yang menetapkan tanggung jawab penyedia model AI atas konten berbahaya.", "Implementasikan usage policy yang ketat dan mekanisme take-down dalam 24 jam."),
    ("judicial", "covered", "UU Kekuasaan Kehakiman Ps. 1 (Kekuasaan Yudisial)", "Kekuasaan kehakiman tetap pada hakim. AI tidak dapat menggantikan keputusan hakim.", "AI harus diposisikan sebagai alat bantu non-determinatif. Hakim wajib memiliki reasoning independen."),
    ("judicial", "partial", "KUHAP Ps. 183 (Standar Pembuktian)", "Standar pembuktian pidana minimum 2 alat bukti. Status bukti AI belum diatur.", "Dokumentasikan validitas dan reliabilitas model AI yang digunakan sebagai referensi. Tidak dijadikan satu-satunya bukti."),
    ("judicial", "gap", "⚠️ Regulasi AI di Peradilan", "BELUM ADA regulasi yang secara eksplisit mengatur penggunaan AI dalam proses peradilan.", "Ikuti prinsip Mahkamah Agung tentang transparansi putusan. Dokumentasikan setiap penggunaan alat AI."),
    ("judicial", "gap", "⚠️ Hak Terdakwa atas Informasi AI", "BELUM ADA hak eksplisit terdakwa untuk mengetahui bagaimana AI menilai kasusnya.", "Terapkan prinsip explainability wajib kepada pihak yang terdampak keputusan AI."),
    ("health", "covered", "UU Kesehatan No. 17/2023", "Mengatur standar layanan kesehatan. AI diagnostik wajib memenuhi standar klinis.", "Pastikan AI diagnostik mendapat persetujuan Kemenkes dan memiliki evidence klinis yang memadai."),
    ("health", "partial", "UU PDP Ps. 26 (Data Kesehatan Sensitif)", "Data kesehatan adalah data sensitif yang memerlukan perlindungan khusus.", "Terapkan enkripsi penuh dan akses kontrol ketat untuk data kesehatan yang diproses AI."),
    ("health", "gap", "⚠️ Regulasi AI Diagnostik Medis", "BELUM ADA regulasi khusus untuk AI yang digunakan dalam diagnosis medis di Indonesia.", "Ikuti standar internasional FDA AI/ML-Based Software for Medical Devices. Dokumentasikan validasi klinis."),
    ("government", "covered", "Perpres 95/2018 SPBE", "Kerangka Sistem Pemerintahan Berbasis Elektronik. Berlaku untuk semua sistem AI pemerintah.", "Pastikan sistem AI terdaftar dan diaudit sebagai bagian dari infrastruktur SPBE."),
    ("government", "partial", "UU PDP (Pemerintah sebagai Pengendali Data)", "Pemerintah sebagai PSE publik wajib mematuhi UU PDP dalam pemrosesan data warga.", "Tunjuk Data Protection Officer (DPO) dan lakukan Data Protection Impact Assessment (DPIA) untuk setiap sistem AI baru."),
    ("government", "gap", "⚠️ Panduan Pengadaan AI Pemerintah", "BELUM ADA panduan khusus pengadaan dan evaluasi sistem AI untuk instansi pemerintah.", "Gunakan OECD AI Procurement Checklist sebagai referensi sementara. Dorong BRIN/Kemkominfo untuk menerbitkan panduan."),
    ("other", "partial", "UU PDP (Prinsip Umum)", "UU PDP berlaku untuk semua pemroses data pribadi di Indonesia tanpa terkecuali.", "Identifikasi semua data pribadi yang diproses oleh sistem AI Anda dan pastikan memiliki dasar hukum yang sah."),
    ("other", "partial", "UU ITE (Sistem Elektronik)", "Jika sistem AI dioperasikan sebagai PSE, wajib tunduk pada PP PSTE dan UU ITE.", "Daftarkan sistem AI sebagai PSE jika melayani publik melalui sistem elektronik."),
    ("other", "gap", "⚠️ Regulasi AI Sektoral Spesifik", "Belum ada regulasi AI horizontal yang mencakup semua sektor di Indonesia.", "Pantau perkembangan regulasi melalui BRIN, Kominfo, dan Kemenko. Terapkan prinsip-prinsip OECD AI secara sukarela."),
]

# Incidents that are always in the registry.
SEED_INCIDENTS = [
    (
        "pdns-2024",
        "Penguncian (enkripsi) paksa dan ekstraksi data pada infrastruktur Pusat Data Nasional Sementara (PDNS) 2 Surabaya yang menggunakan perangkat pemerasan siber (ransomware). Hal ini mengakibatkan kelumpuhan layanan publik ekstensif pada 282 instansi pemerintah.",
        "Tindak Pidana Siber (Illegal Access / Peretasan) & Perbuatan Melawan Hukum (Kelalaian Administrasi)",
        ("Entitas hacker afiliasi LockBit 3.0 (Brain Cipher) sebagai aktor pidana utama.", "Negara Kesatuan Republik Indonesia dan masyarakat umum.", "Pemerintah RI / Pengelola Data Center Publik.", "Ketersediaan Sistem Elektronik Nasional (Data Pribadi Kependudukan, Imigrasi, dll).", "Lahirnya kerugian negara lebih dari Rp 6 Triliun. Berujung pada perdebatan pertanggungjawaban yuridis terkait absennya klausul hukum wajib pencadangan (Mandatory Backup) bagi PSE Publik.", "Kelalaian mitigasi risiko Disaster Recovery oleh penyelenggara menjadi conditio sine qua non (syarat mutlak) yang fatal karena membuka ruang peretasan skala masif."),
        "kritis", 2024, "ransomware",
    ),
    (
        "deepfake-pornografi-2024",
        "Eksploitasi visual menggunakan algoritma Generative AI mutakhir guna mensintesiskan gambar dan video asusila (Deepfake) tak berizin. Konten direproduksi dari foto wajah asli masyarakat sipil serta tokoh publik dan disebarluaskan di platform media sosial.",
        "Tindak Pidana ITE (Penyebaran Konten Kesusilaan) & Pelanggaran Privasi Biometrik.",
        ("Individu anonim (prompter) yang memberikan input kepada mesin AI.", "Individu yang wajahnya dijadikan objek sintesa asusila.", "Pengembang Foundation Model AI dan Platform Media Sosial tempat distribusi.", "Harkat, Kehormatan, Nama Baik, dan Hak atas Data Pribadi (profil visual).", "Timbulnya kerugian immateriil berupa tekanan psikologis akut bagi korban, melahirkan Hak untuk Dilupakan (Right to be Forgotten) dan pemidanaan pelaku.", "Ketiadaan hukum perisai konten (content guardrails) atau kewajiban deteksi watermark memperparah penyebaran perbuatan pidana ini."),
        "kritis", 2024, "ai_misuse",
    ),
    (
        "bsi-ransomware-2023",
        "Kelumpuhan masif layanan Bank Syariah Indonesia (BSI) pada Mei 2023 akibat eksfiltrasi 1,5 TB data sistem oleh LockBit 3.0, disusul ancaman pembocoran 15 juta data nasabah.",
        "Tindak Pidana Pencurian Data Elektronik & PMH.",
        ("Geng Ransomware LockBit 3.0.", "Jutaan nasabah entitas perbankan syariah.", "PT Bank Syariah Indonesia (BSI).", "Hak Rahasia Perbankan nasabah dan operasional Sistem Elektronik Jasa Keuangan.", "Pertanggungjawaban sanksi reputasional dan potensi gugatan wanprestasi/PMH dari nasabah.", "Terdapatnya defisiensi pada mekanisme keamanan berlapis bank menyebabkan pelaku dapat menyusup."),
        "kritis", 2023, "ransomware",
    ),
    (
        "tokopedia-leak-2020",
        "Kebocoran berkas database milik Tokopedia yang memuat 91 juta catatan akun pengguna, yang lantas diperdagangkan di forum peretas global (Dark Web).",
        "Pelanggaran Pemrosesan Data Pribadi (Mendorong UU PDP).",
        ("Hacker forum tak dikenal.", "91 Juta subjek data.", "Tokopedia.", "Data identitas personal dasar.", "Memicu class action jurisprudence secara kultural dan mempercepat pengesahan UU PDP.", "Komitmen proteksi data korporasi optimal ditekankan akibat ketiadaan Hard Law sebelumnya."),
        "kritis", 2020, "data_breach",
    ),
    (
        "bkn-pdl-2024",
        "Insiden kebocoran struktur hierarki negara di mana kurang lebih 4,7 juta basis data profil pelayan publik (PNS) diperdagangkan secara ilegal.",
        "Tindak Pidana Peretasan Klasik & Pelanggaran Standar Keamanan Data Pemerintah.",
        ("Aktor peretas gelap.", "4,7 Juta Pegawai Negeri Sipil & Institusi ASN.", "Badan Kepegawaian Negara (BKN).", "Sistem Meritokrasi Nasional & Privasi Subjek Data.", "Menjadi uji kasus bagi kewajiban mitigasi sanksi institusi publik.", "Kelalaian enkripsi database in-rest menjadikan file ekstraksi dapat dibaca tanpa proteksi."),
        "tinggi", 2024, "data_breach",
    ),
]

# What generated incidents are made of: institutions, cities, years, and kinds of attack with severity and narrative.
INSTITUTIONS = ("Pemkab", "Pemkot", "RSUD", "Universitas", "BPR", "DPRD", "BUMD", "Dinas Pendidikan", "Dinas Kesehatan", "Pengadilan Negeri")
CITIES = ("Malang", "Surabaya", "Madiun", "Kediri", "Ponorogo", "Blitar", "Tulungagung", "Trenggalek", "Pacitan", "Ngawi", "Magetan", "Banyuwangi", "Jember", "Probolinggo", "Pasuruan", "Mojokerto", "Jombang", "Nganjuk", "Bojonegoro", "Tuban", "Lamongan", "Gresik", "Bangkalan", "Sampang", "Pamekasan", "Sumenep", "Sidoarjo", "Bandung", "Semarang", "Yogyakarta")
YEARS = (2021, 2022, 2023, 2024, 2025)
ATTACKS = (
    ("ransomware", "tinggi", "Serangan malware pemeras (ransomware) yang mengenkripsi seluruh server database dan melumpuhkan layanan internal"),
    ("data_breach", "sedang", "Eksfiltrasi database pengguna via SQL Injection dan penjualan data penduduk/pasien di raidforums/breachforums"),
    ("ai_misuse", "sedang", "Disinformasi publik menggunakan Voice Cloning / Deepfake pejabat daerah yang meminta transfer dana fiktif"),
    ("ai_fraud", "tinggi", "Manipulasi dokumen eKYC menggunakan Identitas Sintetis AI untuk pengajuan pinjaman online memakai NIK masyarakat yang bocor"),
)

# The incident dictionary, in the order in which its texts are replaced.
INCIDENT_DICTIONARY = [
    ("Tindak Pidana Siber (Illegal Access / Peretasan) & Perbuatan Melawan Hukum (Kelalaian Administrasi)", "Cybercrime (Illegal Access / Hacking) & Unlawful Act (Administrative Negligence)"),
    ("Tindak Pidana ITE (Penyebaran Konten Kesusilaan) & Pelanggaran Privasi Biometrik.", "ITE Criminal Offense (Obscene Content Distribution) & Biometric Privacy Violation."),
    ("Tindak Pidana Pencurian Data Elektronik & PMH.", "Electronic Data Theft Criminal Offense & Unlawful Act."),
    ("Pelanggaran Pemrosesan Data Pribadi (Mendorong UU PDP).", "Personal Data Processing Violation (Preceding PDP Law)."),
    ("Tindak Pidana Peretasan Klasik & Pelanggaran Standar Keamanan Data Pemerintah.", "Classic Hacking Criminal Offense & Government Data Security Standard Violation."),
    ("Pelanggaran UU Pelindungan Data Pribadi (Kegagalan Pseudo-Anonimisasi)", "Personal Data Protection Law Violation (Failure of Pseudo-Anonymization)"),
    ("Tindak Pidana Ekstorsi & Illegal Access (Pasal 27 ayat 4 & Pasal 30 UU ITE)", "Extortion & Illegal Access Criminal Offense (Article 27 paragraph 4 & Article 30 ITE Law)"),
    ("Tindak Pidana Penipuan Siber Identitas Sintetis (Social Engineering)", "Synthetic Identity Cyber Fraud Criminal Offense (Social Engineering)"),
    ("Kelalaian mitigasi risiko Disaster Recovery oleh penyelenggara menjadi conditio sine qua non (syarat mutlak) yang fatal karena membuka ruang peretasan skala masif.", "Negligence in Disaster Recovery risk mitigation by operators became a fatal conditio sine qua non (absolute condition) exposing massive hacking vectors."),
    ("Ketiadaan hukum perisai konten (content guardrails) atau kewajiban deteksi watermark memperparah penyebaran perbuatan pidana ini.", "Lack of legal content guardrails or mandatory watermark detection aggravated the spread of this criminal act."),
    ("Terdapatnya defisiensi pada mekanisme keamanan berlapis bank menyebabkan pelaku dapat menyusup.", "Deficiencies in the bank's multi-layered security mechanisms allowed perpetrators to infiltrate."),
    ("Komitmen proteksi data korporasi optimal ditekankan akibat ketiadaan Hard Law sebelumnya.", "An optimal corporate data protection commitment was highlighted due to the absence of preceding Hard Law."),
    ("Kelalaian enkripsi database in-rest menjadikan file ekstraksi dapat dibaca tanpa proteksi.", "Negligence in at-rest database encryption made extracted files readable without protection."),
    ("Ketidakpatuhan pembaruan (patching) sistem keamanan SPBE daerah berujung pada invasi peretas.", "Non-compliance with patching local SPBE security systems led to hacker invasions."),
    ("Geng Ransomware LockBit 3.0.", "LockBit 3.0 Ransomware Gang."),
    ("Entitas hacker afiliasi LockBit 3.0 (Brain Cipher) sebagai aktor pidana utama.", "LockBit 3.0 affiliated hacker entities (Brain Cipher) as primary criminal actors."),
    ("Individu anonim (prompter) yang memberikan input kepada mesin AI.", "Anonymous individuals (prompters) who provided input to the AI engine."),
    ("Hacker forum tak dikenal.", "Unknown forum hackers."),
    ("Aktor peretas gelap.", "Dark web threat actors."),
    ("Sindikat kejahatan siber tak berpola (Anonymous/Scammers).", "Unpatterned cybercrime syndicates (Anonymous/Scammers)."),
    ("Penguncian (enkripsi) paksa dan ekstraksi data pada infrastruktur Pusat Data Nasional Sementara (PDNS) 2 Surabaya yang menggunakan perangkat pemerasan siber (ransomware). Hal ini mengakibatkan kelumpuhan layanan publik ekstensif pada 282 instansi pemerintah.", "Forced lock (encryption) and data extraction on the Temporary National Data Center (PDNS) 2 Surabaya infrastructure using ransomware. This resulted in extensive public service paralysis across 282 government agencies."),
    ("Eksploitasi visual menggunakan algoritma Generative AI mutakhir guna mensintesiskan gambar dan video asusila (Deepfake) tak berizin. Konten direproduksi dari foto wajah asli masyarakat sipil serta tokoh publik dan disebarluaskan di platform media sosial.", "Visual exploitation using advanced Generative AI algorithms to synthesize unauthorized obscene images and videos (Deepfakes). Content was reproduced from real facial photos of civilians and public figures and distributed on social media platforms."),
    ("Kelumpuhan masif layanan Bank Syariah Indonesia (BSI) pada Mei 2023 akibat eksfiltrasi 1,5 TB data sistem oleh LockBit 3.0, disusul ancaman pembocoran 15 juta data nasabah.", "Massive paralysis of Bank Syariah Indonesia (BSI) services in May 2023 due to the exfiltration of 1.5 TB of system data by LockBit 3.0, followed by threats to leak 15 million customer data."),
    ("Kebocoran berkas database milik Tokopedia yang memuat 91 juta catatan akun pengguna, yang lantas diperdagangkan di forum peretas global (Dark Web).", "Leak of Tokopedia's database file containing 91 million user account records, which were subsequently traded on global hacker forums (Dark Web)."),
    ("Insiden kebocoran struktur hierarki negara di mana kurang lebih 4,7 juta basis data profil pelayan publik (PNS) diperdagangkan secara ilegal.", "Incident of state hierarchical structure leakage where approximately 4.7 million public servant (PNS) profile databases were traded illegally."),
    ("Eksfiltrasi database pengguna via SQL Injection dan penjualan data penduduk/pasien di raidforums/breachforums milik instansi ", "Exfiltration of user database via SQL Injection and sale of resident/patient data on raidforums/breachforums belonging to the institution "),
    ("Serangan malware pemeras (ransomware) yang mengenkripsi seluruh server database dan melumpuhkan layanan internal milik instansi ", "Ransomware malware attack that encrypted the entire database server and paralyzed internal services belonging to the institution "),
    ("Manipulasi dokumen eKYC menggunakan Identitas Sintetis AI untuk pengajuan pinjaman online memakai NIK masyarakat yang bocor milik instansi ", "Manipulation of eKYC documents using AI Synthetic Identities for online loan applications using leaked citizens' ID numbers belonging to the institution "),
    ("Disinformasi publik menggunakan Voice Cloning / Deepfake pejabat daerah yang meminta transfer dana fiktif milik instansi ", "Public disinformation using Voice Cloning / Deepfake of regional officials requesting fictitious fund transfers belonging to the institution "),
]

# Phrases of the sector cards, in the order in which they are replaced.
SECTOR_PHRASES = [
    ("Keuangan & Fintech AI", "Finance & Fintech AI"),
    ("Prinsip pemrosesan data, dasar hukum — belum mengatur keputusan otomatis AI.", "Data processing principles, legal basis — has not regulated automated AI decisions."),
    ("Manajemen risiko TI Perbankan — tidak spesifik mengatur algoritma AI prediktif.", "Banking IT risk management — does not specifically regulate predictive AI algorithms."),
    ("Sandbox AI Keuangan", "Financial AI Sandbox"),
    ("BELUM ADA: Regulasi sandbox untuk uji coba AI di sektor keuangan.", "NOT YET EXISTS: Sandbox regulation for AI trials in the financial sector."),
    ("Kewajiban Audit Bias", "Bias Audit Obligation"),
    ("BELUM ADA: Kewajiban audit bias algoritmik untuk credit scoring.", "NOT YET EXISTS: Obligation for algorithmic bias audit for credit scoring."),
    ("Penyelenggaraan layanan pinjam meminjam berbasis teknologi.", "Organizing technology-based lending and borrowing services."),
    ("BELUM ADA: Kewajiban pengawasan manusia dalam keputusan kredit otomatis.", "NOT YET EXISTS: Obligation for human oversight in automated credit decisions."),
    ("Studi merekomendasikan: regulasi berbasis sandbox, kewajiban audit bias algoritma credit scoring, dan mekanisme pengawasan manusia (human-in-the-loop) wajib untuk keputusan keuangan berrisiko tinggi.", "Studies recommend: sandbox-based regulation, obligation to audit algorithms for credit scoring bias, and mandatory human-in-the-loop oversight mechanisms for high-risk financial decisions."),
    ("Facial Recognition & Biometrik", "Facial Recognition & Biometrics"),
    ("eKYC · Pengawasan Publik · Akses Sistem", "eKYC · Public Surveillance · System Access"),
    ("Mengatur data biometrik sebagai data sensitif — tidak ada ketentuan teknis FR.", "Regulates biometric data as sensitive data — no technical provisions for FR."),
    ("Keamanan sistem elektronik — tidak menyebut facial recognition secara eksplisit.", "Security of electronic systems — does not explicitly mention facial recognition."),
    ("Izin Khusus Penggunaan FR", "Special Permit for FR Use"),
    ("BELUM ADA: Regulasi yang mensyaratkan izin tertulis sebelum menggunakan FR di ruang publik.", "NOT YET EXISTS: Regulation requiring written permission before using FR in public spaces."),
    ("Standar Akurasi & Bias FR", "FR Accuracy & Bias Standards"),
    ("BELUM ADA: Standar teknis akurasi pengenalan wajah dan larangan bias demografis.", "NOT YET EXISTS: Technical standards for facial recognition accuracy and prohibition of demographic bias."),
    ("Hak Menolak FR", "Right to Refuse FR"),
    ("BELUM ADA: Hak eksplisit warga untuk menolak pengenalan wajah.", "NOT YET EXISTS: Explicit right of citizens to refuse facial recognition."),
    ("Studi merekomendasikan: regulasi khusus facial recognition, mekanisme pengawasan mandiri, larangan penggunaan FR untuk profiling massal oleh sektor swasta tanpa izin eksplisit.", "Studies recommend: specific regulation for facial recognition, independent oversight mechanisms, and prohibition of FR use for mass profiling by the private sector without explicit permission."),
    ("E-Commerce & Perdagangan Digital", "E-Commerce & Digital Trade"),
    ("Algoritma Rekomendasi · Ranking · Personalisasi Harga", "Recommendation Algorithms · Ranking · Price Personalization"),
    ("Informasi produk dalam perdagangan elektronik.", "Product information in electronic trading."),
    ("Hak atas informasi yang benar — tidak eksplisit mengatur transparansi algoritma.", "Right to correct information — does not explicitly regulate algorithm transparency."),
    ("Konten sistem elektronik — tidak mengatur algoritma ranking produk.", "Electronic system content — does not regulate product ranking algorithms."),
    ("Larangan Self-Preferencing", "Prohibition of Self-Preferencing"),
    ("BELUM ADA: Larangan platform lebih mengutamakan produk sendiri dalam algoritma.", "NOT YET EXISTS: Platform prohibition from prioritizing its own products in algorithms."),
    ("Transparansi Algoritma Ranking", "Ranking Algorithm Transparency"),
    ("BELUM ADA: Kewajiban mengungkap faktor penentu ranking produk kepada pelaku usaha.", "NOT YET EXISTS: Obligation to disclose factors determining product ranking to businesses."),
    ("Personalisasi Harga AI", "AI Price Personalization"),
    ("BELUM ADA: Larangan diskriminasi harga berbasis profiling AI.", "NOT YET EXISTS: Prohibition of price discrimination based on AI profiling."),
    ("Studi merekomendasikan: kewajiban transparansi faktor ranking, larangan self-preferencing, dan mekanisme keberatan pedagang terhadap keputusan algoritma.", "Studies recommend: transparency obligation for ranking factors, prohibition of self-preferencing, and merchant objection mechanisms against algorithmic decisions."),
    ("AI-Generated Content & Media", "AI-Generated Content & Media"),
    ("Deepfake · Voice Cloning · Synthetic Media", "Deepfake · Voice Cloning · Synthetic Media"),
    ("Melarang konten asusila — tidak ada ketentuan khusus konten sintetis AI.", "Prohibits obscene content — no specific provisions for AI synthetic content."),
    ("Melarang hoaks — sulit dibuktikan untuk deepfake tanpa watermark mandatori.", "Prohibits hoaxes — difficult to prove for deepfakes without a mandatory watermark."),
    ("Karya cipta — belum mengatur kepemilikan konten yang dihasilkan AI.", "Copyright — has not regulated ownership of AI-generated content."),
    ("Label Wajib Konten AI", "Mandatory AI Content Label"),
    ("BELUM ADA: Kewajiban watermark/label visible pada setiap konten yang dihasilkan AI.", "NOT YET EXISTS: Obligation for visible watermark/label on any AI-generated content."),
    ("Akuntabilitas Platform", "Platform Accountability"),
    ("BELUM ADA: Tanggung jawab platform AI atas konten berbahaya yang dihasilkan.", "NOT YET EXISTS: AI platform responsibility for generated harmful content."),
    ("Mekanisme Pengaduan Korban Deepfake", "Deepfake Victim Grievance Mechanism"),
    ("BELUM ADA: Prosedur pengaduan cepat dan take-down wajib untuk konten deepfake non-konsensual.", "NOT YET EXISTS: Fast reporting and mandatory take-down procedures for non-consensual deepfake content."),
    ("Studi merekomendasikan: kewajiban watermarking konten AI, akuntabilitas penyedia model, dan mekanisme pengaduan serta take-down yang cepat bagi korban deepfake.", "Studies recommend: AI content watermarking obligation, model provider accountability, and fast grievance/take-down mechanisms for deepfake victims."),
    ("AI di Peradilan & Hukum", "AI in Justice & Law"),
    ("Sistem Prediksi Vonis · RisikoPenilaian Tersangka · Legal Research AI", "Verdict Prediction Systems · Suspect Risk Assessment · Legal Research AI"),
    ("Hakim sebagai pemegang kekuasaan yudisial — melarang substitusi hakim.", "Judges as holders of judicial power — prohibits judge substitution."),
    ("Standar pembuktian — bukti AI belum diatur validitasnya secara eksplisit.", "Proof standards — AI evidence validity has not been explicitly regulated."),
    ("Batas Peran AI di Pengadilan", "Limits of AI's Role in Courts"),
    ("BELUM ADA: Regulasi yang menetapkan AI hanya sebagai \"alat bantu\" hakim.", "NOT YET EXISTS: Regulation designating AI solely as an \"assistant\" to judges."),
    ("Transparansi Algoritma Penilaian", "Assessment Algorithm Transparency"),
    ("BELUM ADA: Hak terdakwa mengetahui bagaimana AI menilai risiko.", "NOT YET EXISTS: Defendant's right to know how AI assesses their risk."),
    ("Standar Validasi Model AI Peradilan", "Judicial AI Model Validation Standard"),
    ("BELUM ADA: Lembaga yang berwenang memvalidasi AI yang digunakan di peradilan.", "NOT YET EXISTS: Authority responsible for validating AI used in the judicial system."),
    ("Studi merekomendasikan: AI di peradilan harus dibatasi sebagai alat bantu (non-determinatif), hakim tetap harus memiliki reasoning independen, dan setiap AI peradilan wajib diaudit secara berkala.", "Studies recommend: AI in the judiciary must be limited as a tool (non-determinative), judges must retain independent reasoning, and judicial AI must be audited periodically."),
]
